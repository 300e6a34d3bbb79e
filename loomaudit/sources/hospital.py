"""A worked extraction: plain hospital tables to events, labels and splits.

Tables are CSV files, gzipped or not, read as text so that ids stay as written:
``patients`` (subject_id, gender, anchor_age, dod), ``admissions`` (subject_id, hadm_id,
admittime, admission_type, race), ``diagnoses`` (subject_id, hadm_id, icd_code,
icd_version) and ``labs`` (subject_id, hadm_id, charttime, itemid, valuenum).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions.normalize import coerce_events
from .features import read_text_gz
from .files import exists
from .splits import normalise

TABLES = ("patients", "admissions", "diagnoses", "labs")


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    out = {}
    for name in TABLES:
        found = next((p for p in (f"{folder}/{name}.csv.gz", f"{folder}/{name}.csv") if exists(p)), None)
        if found is None:
            raise InputError(f"{folder} has no table {name}", path=folder, table=name)
        out[name] = read_text_gz(spark, found)
    return out


def _event(df: DataFrame, time: Column | None, code: Column, system: str | Column, number: Column | None = None, visit: str | None = None) -> DataFrame:
    text = lambda v: F.lit(None).cast("string") if v is None else v
    system = F.lit(system) if isinstance(system, str) else system
    return df.select(
        "subject_id", text(time).alias("time"), code.alias("code"), system.alias("code_system"), text(number).alias("numeric_value"), (F.col(visit) if visit else text(None)).alias("encounter_id")
    ).filter("code is not null")


def events(tables: dict[str, DataFrame]) -> DataFrame:
    """Admissions when they begin, deaths, diagnoses at their admission, labs, and static facts."""
    patients, stays = tables["patients"], tables["admissions"]
    when = stays.select(F.col("hadm_id").alias("__stay"), "admittime")
    coded = tables["diagnoses"].join(when, F.col("hadm_id") == F.col("__stay"), "left").drop("__stay")
    facts = F.explode(F.array(F.struct(F.lit("GENDER").alias("system"), F.col("gender").alias("code")), F.struct(F.lit("AGE").alias("system"), F.col("anchor_age").alias("code"))))
    static = patients.select("subject_id", facts.alias("fact"))
    parts = [
        _event(stays, F.col("admittime"), F.coalesce("admission_type", F.lit("ADMISSION")), "ADMISSION", visit="hadm_id"),
        _event(patients.filter("dod is not null"), F.col("dod"), F.lit("MEDS_DEATH"), F.lit(None).cast("string")),
        _event(coded, F.col("admittime"), F.col("icd_code"), F.concat(F.lit("ICD"), F.col("icd_version")), visit="hadm_id"),
        _event(tables["labs"], F.col("charttime"), F.col("itemid"), "LAB", F.col("valuenum"), "hadm_id"),
        _event(static, None, F.col("fact.code"), F.col("fact.system")),
        _event(stays.select("subject_id", "race").distinct(), None, F.col("race"), "RACE"),
    ]
    return coerce_events(reduce(DataFrame.unionByName, parts))


def labels(found: DataFrame, outcomes: list[str], horizon_days: float) -> DataFrame:
    """The first admission is the index; positive if an outcome follows at or after it within the horizon.

    An outcome at the index itself counts on purpose: it is what LK002 and LK007 are to find.
    """
    index = found.filter("code_system = 'ADMISSION'").groupBy("subject_id").agg(F.min("time").alias("index_date"))
    hits = found.filter(F.col("code").isin(outcomes)).join(index, "subject_id")
    days = F.expr("timestampdiff(SECOND, index_date, time) / 86400.0D")
    hits = hits.filter((days >= 0) & (days <= horizon_days)).select("subject_id").distinct().withColumn("hit", F.lit(True))
    return index.join(hits, "subject_id", "left").select("subject_id", "index_date", F.coalesce("hit", F.lit(False)).alias("label"))


def time_splits(index: DataFrame, shares: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """Train, valid and test by index date, cut at exact percentiles."""
    cuts = index.agg(F.percentile(F.unix_micros(F.col("index_date").cast("timestamp")), F.array(*map(F.lit, shares))).alias("c"))
    at = F.unix_micros(F.col("index_date").cast("timestamp"))
    named = F.when(at <= F.col("c")[0], "train").when(at <= F.col("c")[1], "valid").otherwise("test")
    return normalise(index.crossJoin(F.broadcast(cuts)).select("subject_id", named.alias("split")))  # one row of cuts
