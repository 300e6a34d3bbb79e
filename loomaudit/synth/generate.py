"""Synthetic cohorts that are clean by construction, generated in parallel.

Every draw is a hash of (seed, subject, slot), so a row does not depend on how rows
are dealt over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.context import AuditContext
from ..plans.task import TaskSpec

#: Codes of the cohort: own values.
INDEX = ("VISIT", "ed_visit")
OUTCOMES = ("E10.10", "E11.10", "E13.10")
PROXIES = ("insulin_drip", "bicarb_iv")
HISTORY = ("E11.9", "I10", "J45.909", "K21.9", "M54.5", "N18.3", "E78.5", "F41.1")
LABS = ("a1c", "glucose", "potassium", "creatinine")
GENDERS = ("GENDER_F", "GENDER_M", "GENDER_X")
RACES = tuple(f"RACE_{i}" for i in range(1, 7))
EPOCH = "2018-01-01 08:00:00"
DAY = 86_400


def default_task(horizon: str = "2y") -> TaskSpec:
    return TaskSpec.from_dict(
        {
            "task": "dka_2y",
            "description": "Diabetic ketoacidosis within two years of the first emergency visit.",
            "index": {"event": INDEX[1], "code_system": INDEX[0], "occurrence": "first"},
            "outcome": {
                "codes": [{"values": list(OUTCOMES), "system": "ICD10CM"}],
                "proxy_codes": [{"values": list(PROXIES), "system": "RX"}],
                "competing_codes": [{"values": ["MEDS_DEATH"]}],
            },
            "horizon": horizon,
            "splits": {"strategy": "temporal", "temporal": True, "group_column": "encounter_id"},
        }
    )


def draw(seed: int, slot: str, *keys: Column) -> Column:
    """A number in [0, 1) from the seed, a name and some columns."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(slot), *keys), 11)
    return bits.cast("double") / float(1 << 53)


def below(n: int, *args) -> Column:
    return F.floor(draw(*args) * n).cast("int")


def pick(values: tuple, *args) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), below(len(values), *args) + 1)


def after(time: Column, days: Column) -> Column:
    return F.timestamp_add("SECOND", F.floor(days * DAY).cast("int"), time)


@dataclass(frozen=True)
class Cohort:
    """Events, labels, splits and perhaps features, with the task they are for."""

    events: DataFrame
    labels: DataFrame
    splits: DataFrame
    task: TaskSpec
    seed: int
    features: DataFrame | None = None
    planted: dict | None = None

    def replace(self, **changes) -> Cohort:
        return replace(self, **changes)

    def context(self) -> AuditContext:
        return AuditContext.from_frames(self.events, self.task, self.splits, self.labels, self.features)

    @property
    def n_subjects(self) -> int:
        return self.labels.select("subject_id").distinct().count()

    def describe(self) -> dict:
        positive, total = self.labels.agg(F.count_if("label"), F.count("*")).first()
        return {"n_subjects": total, "n_positive": positive, "n_events": self.events.count(), "seed": self.seed, "planted": self.planted or {}}

    def write(self, folder: str) -> None:
        """MEDS shards, labels, splits, task, features and a manifest."""
        import json

        from ..sources import meds
        from ..sources.files import write_text

        folder = str(folder).rstrip("/")
        meds.write_meds_dataset(self.events, folder, self.task.task, self.splits)
        self.labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
        listed: dict[str, list] = {}
        for r in self.splits.distinct().orderBy("split", "subject_id").toLocalIterator():  # the format is one JSON document
            listed.setdefault(r.split, []).append(r.subject_id)
        write_text(f"{folder}/splits.json", json.dumps(listed, indent=2))
        import yaml

        write_text(f"{folder}/task.yaml", yaml.safe_dump(self.task.to_dict(), sort_keys=False))
        if self.features is not None:
            self.features.write.mode("overwrite").parquet(f"{folder}/features.parquet")
        write_text(f"{folder}/manifest.json", json.dumps(self.describe(), indent=2))
        write_text(f"{folder}/planted_leaks.json", json.dumps(self.planted or {}, indent=2))


def generate(spark: SparkSession, n: int = 500, seed: int = 0, positive_rate: float = 0.2, horizon_days: float = 730.5, history_years: float = 2.0) -> Cohort:
    """A cohort on which all ten checks run and none fires."""
    if n < 1 or not 0 <= positive_rate <= 1 or horizon_days <= 0:
        raise ValueError("n must be positive, positive_rate within 0 and 1, and horizon_days positive")
    k = F.col("id")
    who = F.concat(F.lit("S"), F.lpad(k.cast("string"), 6, "0"))
    start = F.lit(EPOCH).cast("timestamp_ntz")
    base = spark.range(n).select(
        k,
        who.alias("subject_id"),
        after(start, draw(seed, "index", k) * 1095).alias("index_date"),
        (draw(seed, "label", k) < positive_rate).alias("label"),
    )
    event = lambda time, code, system, encounter, value=None: F.struct(
        time.alias("time"), code.alias("code"), F.lit(system).alias("code_system"), F.lit(value).cast("double").alias("numeric_value") if value is None else value.alias("numeric_value"), encounter.alias("encounter_id")
    )
    never, nowhere = F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("string")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    in_encounter = lambda tag: F.concat("subject_id", F.lit(tag))
    facts = [
        pick(GENDERS, seed, "gender", k),
        pick(RACES, seed, "race", k),
        text("DECADE_", 193 + below(7, seed, "decade", k)),
        text("POSTAL_", below(4000, seed, "postal", k)),
        F.concat(F.lit("BORN_ON_"), F.lpad(k.cast("string"), 8, "0")),
    ]
    rows = base.select("*", F.explode(F.array(*(event(never, f, "DEMOGRAPHIC", nowhere) for f in facts))).alias("e"))

    visits = base.select("*", F.explode(F.sequence(F.lit(1), 1 + below(4, seed, "visits", k))).alias("v"))
    v = F.col("v")
    back = after(F.col("index_date"), -(draw(seed, "when", k, v) * (history_years * 365.25 - 2) + 1))
    visits = visits.withColumn("t", back).withColumn("enc", F.concat("subject_id", F.lit("-E"), v.cast("string")))
    codes = visits.select("*", F.explode(F.sequence(F.lit(1), 1 + below(3, seed, "codes", k, v))).alias("c"))
    coded = codes.select("id", "subject_id", "index_date", "label", event(F.col("t"), pick(HISTORY, seed, "code", k, v, F.col("c")), "ICD10CM", F.col("enc")).alias("e"))
    lab = event(F.timestamp_add("HOUR", F.lit(1), F.col("t")), pick(LABS, seed, "lab", k, v), "LAB", F.col("enc"), F.round(4 + draw(seed, "value", k, v) * 8, 2))
    labs = visits.select("id", "subject_id", "index_date", "label", lab.alias("e"))

    index = event(F.col("index_date"), F.lit(INDEX[1]), INDEX[0], in_encounter("-IDX"))
    outcome = event(after(F.col("index_date"), 1 + draw(seed, "outcome", k) * (horizon_days - 2)), pick(OUTCOMES, seed, "which", k), "ICD10CM", in_encounter("-OUT"))
    closing = event(after(F.col("index_date"), horizon_days + 1 + draw(seed, "end", k) * 59), F.lit(INDEX[1]), INDEX[0], in_encounter("-END"))
    follow = lambda i: event(
        after(F.col("index_date"), (draw(seed, "follow", k, F.lit(i)) * 0.9 + 0.02) * horizon_days), pick(HISTORY, seed, "next", k, F.lit(i)), "ICD10CM", in_encounter(f"-F{i}")
    )
    more = F.slice(F.array(*(follow(i) for i in (1, 2, 3))), F.lit(1), 1 + below(3, seed, "follows", k))
    later = base.select("*", F.explode(F.concat(F.array(index), F.when(F.col("label"), F.array(outcome)).otherwise(F.concat(more, F.array(closing))))).alias("e"))

    columns = ["subject_id", "e.time", "e.code", "e.code_system", "e.numeric_value", F.lit(None).cast("string").alias("text_value"), "e.encounter_id"]
    events = rows.select(*columns)
    for part in (coded, labs, later):
        events = events.unionByName(part.select(*columns))
    return Cohort(events, base.select("subject_id", "index_date", "label"), _time_splits(base, n), default_task(), seed)


def _time_splits(base: DataFrame, n: int) -> DataFrame:
    """60, 20 and 20 percent by index date: cut at two order statistics, no global window."""
    order = F.struct("index_date", "subject_id")
    cuts = {}
    for name, share in (("a", 0.6), ("b", 0.8)):
        rank = max(1, int(n * share))
        cuts[name] = base.select(order.alias("o")).orderBy("o").limit(rank).agg(F.max("o").alias(name))
    both = cuts["a"].crossJoin(cuts["b"])  # one row each
    split = F.when(order <= F.col("a"), "train").when(order <= F.col("b"), "valid").otherwise("test")
    return base.crossJoin(F.broadcast(both)).select("subject_id", split.alias("split"))
