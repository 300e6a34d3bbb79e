"""Resolved inputs of an audit and the relations that its checks share."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..sources.features import FeatureMatrix
from .task import CodeSet, TaskSpec

#: Whole seconds between index date and event, as days.
DAYS = "timestampdiff(SECOND, index_date, time) / 86400.0D"


def index_from_events(events: DataFrame, task: TaskSpec, systems: bool = True) -> DataFrame:
    """First or last time of the index event for each subject."""
    pick = F.min if task.index.occurrence == "first" else F.max
    hit = F.col("code") == task.index.event
    if task.index.code_system is not None and systems:
        hit = hit & (F.col("code_system") == task.index.code_system)
    return nz.timed(events).filter(hit & F.col("subject_id").isNotNull()).groupBy("subject_id").agg(pick("time").alias("index_date"))


def index_from_labels(labels: DataFrame) -> DataFrame:
    """The earliest index date that labels state for each subject.

    A row order does not exist in a DataFrame, so of several dates the earliest counts.
    """
    stated = labels.filter("index_date is not null and subject_id is not null")
    return stated.groupBy("subject_id").agg(F.min("index_date").alias("index_date"))


def with_index(events: DataFrame, index: DataFrame) -> DataFrame:
    """Timed events of subjects with an index date, with that date."""
    return nz.timed(events).join(index, "subject_id")


def matches(sets: tuple[CodeSet, ...], systems: bool = True) -> Column:
    """Whether an event's code is in any of the sets, systems honoured where stated."""
    def one(s: CodeSet) -> Column:
        hit = F.col("code").isin(*s.values)
        return hit & (F.col("code_system") == s.system) if s.system is not None and systems else hit

    return reduce(lambda a, b: a | b, map(one, sets), F.lit(False))


def match_code_sets(events: DataFrame, sets: tuple[CodeSet, ...], systems: bool = True) -> DataFrame:
    """Events whose code is in a set; exact duplicates collapse.

    The filter stands below any join and the de-duplication above it, so only matching
    rows are ever shuffled.
    """
    return events.filter(F.coalesce(matches(sets, systems), F.lit(False))).dropDuplicates()


class AuditContext:
    """Events, task, splits, labels and features of one audit.

    ``splits`` is a DataFrame (subject_id, split); ``labels`` one with subject_id,
    index_date and label.  Nothing is computed before a check asks for it.
    """

    def __init__(
        self,
        events: DataFrame,
        task: TaskSpec,
        splits: DataFrame | None = None,
        labels: DataFrame | None = None,
        features: FeatureMatrix | None = None,
        warnings: tuple[str, ...] = (),
        source: tuple[str, str | None] = ("frames", None),
        metadata: dict | None = None,
    ):
        self.task, self.splits, self.labels, self.features = task, splits, labels, features
        self.events = nz.coerce_events(events, task.splits.group_column)
        self.load_warnings = list(warnings)
        (self.source_format, self.source_path), self.dataset_metadata = source, metadata or {}
        self.spark = events.sparkSession

    @classmethod
    def from_frames(cls, events: DataFrame, task, splits=None, labels: DataFrame | None = None, features=None) -> AuditContext:
        from ..sources.features import build_feature_matrix
        from ..sources.splits import splits_from_mapping

        task = task if isinstance(task, TaskSpec) else TaskSpec.from_dict(task)
        if isinstance(splits, dict):
            splits = splits_from_mapping(events.sparkSession, splits)
        if isinstance(features, DataFrame):
            features = build_feature_matrix(features)
        return cls(events, task, splits, labels, features)

    @classmethod
    def from_meds(
        cls, spark, directory, task, splits=None, labels=None, features=None, encounter_column: str | None = None, feature_subject: str | None = None, feature_time: str | None = None
    ) -> AuditContext:
        from ..sources import features as fx
        from ..sources import meds
        from ..sources import splits as sp

        notes = []
        task = task if isinstance(task, TaskSpec) else TaskSpec.from_yaml(task)
        for paths in meds.shard_schemas(spark, directory).values():
            notes += meds.schema_warnings(spark.read.parquet(paths[0]))
        id_map = meds.read_subject_id_map(spark, directory)
        events = meds.read_meds_events(spark, directory, encounter_column, task.splits.group_column)
        if splits is None and (found := meds.find_splits(directory)):
            splits = found
            notes.append(f"splits are those of the dataset itself: {found}")
        split_frame = sp.read_splits(spark, splits, id_map) if splits is not None else None
        label_frame = meds.restore_ids(fx.read_labels(spark, labels), id_map, "labels", True) if labels is not None else None
        matrix = fx.read_feature_matrix(spark, features, feature_subject, feature_time) if features is not None else None
        if matrix is not None and id_map is not None:
            matrix = matrix.with_frame(meds.restore_ids(matrix.frame, id_map, "features", True))
        return cls(events, task, split_frame, label_frame, matrix, tuple(dict.fromkeys(notes)), ("meds", str(directory)), meds.read_dataset_metadata(directory))

    @classmethod
    def from_omop(cls, spark, directory, task, splits=None, labels=None, features=None, feature_subject: str | None = None, feature_time: str | None = None) -> AuditContext:
        from ..sources import features as fx
        from ..sources import omop
        from ..sources import splits as sp

        task = task if isinstance(task, TaskSpec) else TaskSpec.from_yaml(task)
        notes = ("OMOP tables found: " + ", ".join(omop.tables_present(directory)),)
        return cls(
            omop.read_omop_events(spark, directory),
            task,
            sp.read_splits(spark, splits) if splits is not None else None,
            fx.read_labels(spark, labels) if labels is not None else None,
            fx.read_feature_matrix(spark, features, feature_subject, feature_time) if features is not None else None,
            notes,
            ("omop", str(directory)),
        )

    # relations

    @cached_property
    def profile(self) -> dict:
        """All guard numbers of the events, from one aggregate."""
        return self.events.agg(*nz.profile_columns()).first().asDict()

    @property
    def n_subjects(self) -> int:
        return self.profile["n_subjects"]

    @property
    def has_encounters(self) -> bool:
        return self.profile["null_encounter_id"] < self.profile["n_events"]

    @property
    def has_systems(self) -> bool:
        return self.profile["null_code_system"] < self.profile["n_events"]

    @cached_property
    def index(self) -> DataFrame:
        if self.labels is not None and "index_date" in self.labels.columns:
            return index_from_labels(self.labels).persist()
        if self.task.index.event is None:
            return self.spark.createDataFrame([], "subject_id string, index_date timestamp_ntz")
        return index_from_events(self.events, self.task, self.has_systems).persist()

    @cached_property
    def n_index(self) -> int:
        return self.index.count()

    @property
    def timed(self) -> DataFrame:
        return nz.timed(self.events)

    def with_index(self) -> DataFrame:
        return with_index(self.events, self.index)

    def match(self, frame: DataFrame, sets: tuple[CodeSet, ...]) -> DataFrame:
        return match_code_sets(frame, sets, self.has_systems)

    @cached_property
    def split_sizes(self) -> dict[str, int]:
        """Subjects of each split; there are a handful of splits."""
        return {} if self.splits is None else {r.split: r.n for r in self.splits.groupBy("split").agg(F.count_distinct("subject_id").alias("n")).collect()}

    @cached_property
    def data_hash(self) -> str:
        return nz.events_hash(self.events)

    def known_subjects(self) -> DataFrame:
        """Subjects that any input names; evidence must be about one of them."""
        out = self.events.select("subject_id")
        for other in (self.labels, self.splits, None if self.features is None else self.features.frame):
            if other is not None:
                out = out.unionByName(other.select("subject_id"))
        return out

    def split_warnings(self) -> list[str]:
        if self.splits is None:
            return []
        if not self.split_sizes:
            return ["the splits are empty"]
        out = [] if len(self.split_sizes) > 1 else ["there is only one split"]
        have = self.events.select("subject_id").filter("subject_id is not null").distinct()
        mine = self.splits.select("subject_id").filter("subject_id is not null").distinct()
        if n := mine.join(have, "subject_id", "left_anti").count():
            out.append(f"{n} subject(s) of the splits have no event")
        if n := have.join(mine, "subject_id", "left_anti").count():
            out.append(f"{n} subject(s) with events are in no split")
        return out

    def warnings(self) -> list[str]:
        out = [*self.load_warnings, *nz.warnings_of(self.profile), *self.task.warnings(), *self.split_warnings()]
        if self.features is not None:
            out += self.features.warnings()
        if not self.n_index:
            out.append("no subject has an index date, so every check that needs one is skipped: name an index event that the data have, or give labels with a time")
        elif self.n_index < self.n_subjects:
            out.append(f"{self.n_index} of {self.n_subjects} subjects have an index date; the others are not checked against it")
        return list(dict.fromkeys(out))

    def describe(self) -> dict:
        return {
            "source_format": self.source_format,
            "source_path": self.source_path,
            "dataset_metadata": self.dataset_metadata,
            **{k: self.profile[k] for k in ("n_events", "n_subjects")},
            "n_timed_events": self.profile["n_events"] - self.profile["null_time"],
            "n_static_events": self.profile["null_time"],
            "n_index_dates": self.n_index,
            "has_encounters": self.has_encounters,
            "has_code_systems": self.has_systems,
            "data_hash": self.data_hash,
            "splits": self.split_sizes,
            "has_labels": self.labels is not None,
            "features": None if self.features is None else self.features.describe(),
            "task": self.task.describe(),
        }

    def close(self) -> None:
        if "index" in self.__dict__:
            self.index.unpersist()
