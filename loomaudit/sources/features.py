"""Feature matrices and labels."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InputError, SchemaError
from ..functions.normalize import lossy

#: Accepted column names, in order of preference, whatever their case: fixed values.
SUBJECT_NAMES = ("subject_id", "person_id", "patient_id", "subject", "id")
TIME_NAMES = ("prediction_time", "index_date", "index_time", "as_of", "as_of_time", "time", "timestamp")
LABEL_TIME_NAMES = ("prediction_time", "index_date", "index_time", "time")
LABEL_NAMES = ("boolean_value", "label", "y", "outcome", "target", "integer_value", "float_value")
MATRIX_LABEL_NAMES = ("label", "y", "outcome", "target", "boolean_value")
#: Further columns of a matrix that are no features: fixed values.
OTHER_NAMES = ("split", "fold", "categorical_value", "encounter_id", "visit_id", "hadm_id")


def locate(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The first candidate that is a column, whatever its case."""
    lower = {c.lower(): c for c in reversed(columns)}
    return next((lower[n.lower()] for n in names if n.lower() in lower), None)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV or TSV by suffix."""
    name = str(path).lower().rstrip("/")
    if name.endswith((".parquet", ".pq")):
        return spark.read.parquet(str(path))
    for suffix, sep in ((".csv", ","), (".tsv", "\t")):
        if name.endswith(suffix):
            return spark.read.csv(str(path), header=True, sep=sep, inferSchema=True, samplingRatio=1.0)
    raise InputError(f"cannot tell the format of {path}; use .parquet, .pq, .csv or .tsv", path=path)


def read_text_gz(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file, gzipped or not, with every column as text, so that ids stay as written."""
    return spark.read.csv(str(path), header=True, inferSchema=False)


@dataclass(frozen=True)
class FeatureMatrix:
    """A wide frame whose id, time and label columns have canonical names."""

    frame: DataFrame
    time_column: str | None
    label_column: str | None
    features: tuple[str, ...]

    def with_frame(self, frame: DataFrame) -> FeatureMatrix:
        return replace(self, frame=frame)

    @property
    def n_features(self) -> int:
        return len(self.features)

    def subjects(self) -> DataFrame:
        return self.frame.select("subject_id").filter("subject_id is not null").distinct().orderBy("subject_id")

    @property
    def numeric_features(self) -> list[str]:
        return [c for c in self.features if isinstance(self.frame.schema[c].dataType, T.NumericType)]

    def _counts(self) -> tuple[int, int]:
        return tuple(self.frame.agg(F.count("*"), F.count_distinct("subject_id")).first())

    def describe(self) -> dict:
        rows, subjects = self._counts()
        return {"rows": rows, "subjects": subjects, "features": self.n_features, "time_column": self.time_column, "label_column": self.label_column}

    def warnings(self) -> list[str]:
        out = [] if self.time_column else ["the feature matrix has no time column: LK001 cannot compare its rows with index dates"]
        if not self.features:
            out.append("the feature matrix has no features")
        if not self.time_column:
            rows, subjects = self._counts()
            if rows > subjects:
                out.append(f"the feature matrix has {rows} rows for {subjects} subjects and no time column")
        return out


def build_feature_matrix(df: DataFrame, subject_column: str | None = None, time_column: str | None = None) -> FeatureMatrix:
    """Find id, time and label; what is no id, time, label, split or visit is a feature.  Overrides are exact names."""
    for wanted in (subject_column, time_column):
        if wanted is not None and wanted not in df.columns:
            raise SchemaError(f"the feature matrix has no column {wanted}; found {', '.join(df.columns)}", column=wanted)
    who = subject_column or locate(df.columns, SUBJECT_NAMES)
    if who is None:
        raise SchemaError(f"the feature matrix has no subject column; tried {', '.join(SUBJECT_NAMES)}", column="subject_id")
    when = time_column or locate(df.columns, TIME_NAMES)
    label = locate(df.columns, MATRIX_LABEL_NAMES)
    known = {*SUBJECT_NAMES, *TIME_NAMES, *LABEL_NAMES, *OTHER_NAMES}
    rest = [c for c in df.columns if c not in (who, when, label) and c.lower() != "subject_id" and c.lower() not in ("feature_time", "label")]
    features = tuple(c for c in rest if c.lower() not in known)
    kept = [lossy(F.col(who), T.StringType(), df.schema[who].dataType).alias("subject_id")]
    if when:
        kept.append(lossy(F.col(when), T.TimestampNTZType(), df.schema[when].dataType).alias("feature_time"))
    if label:
        kept.append(truth(df, label).alias("label"))
    return FeatureMatrix(df.select(*kept, *rest), when, label, features)


def read_feature_matrix(spark: SparkSession, path: str, subject_column: str | None = None, time_column: str | None = None) -> FeatureMatrix:
    return build_feature_matrix(read_table(spark, path), subject_column, time_column)


def truth(df: DataFrame, column: str):
    """Numbers: whether not zero.  Text: true or false alone.  Anything else is null."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.BooleanType):
        return c
    if isinstance(kind, T.NumericType):
        return c != 0
    if isinstance(kind, T.StringType):
        word = F.lower(F.trim(c))
        return F.when(word == "true", True).when(word == "false", False)
    return F.lit(None).cast("boolean")


def build_labels(df: DataFrame) -> DataFrame:
    """``subject_id, index_date, label``; the label is the first known of the candidates, boolean first."""
    who, when = locate(df.columns, SUBJECT_NAMES), locate(df.columns, LABEL_TIME_NAMES)
    if who is None:
        raise SchemaError(f"labels have no subject column; tried {', '.join(SUBJECT_NAMES)}; found {', '.join(df.columns)}", column="subject_id")
    if when is None:
        raise SchemaError(f"labels have no column for the index date; tried {', '.join(LABEL_TIME_NAMES)}; found {', '.join(df.columns)}", column="index_date")
    kept = [lossy(F.col(who), T.StringType(), df.schema[who].dataType).alias("subject_id")]
    kept.append(lossy(F.col(when), T.TimestampNTZType(), df.schema[when].dataType).alias("index_date"))
    found = [c for c in (locate(df.columns, (n,)) for n in LABEL_NAMES) if c]
    kept.append(F.coalesce(*(truth(df, c) for c in found), F.lit(None).cast("boolean")).alias("label"))
    return df.select(*kept)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return build_labels(read_table(spark, path))
