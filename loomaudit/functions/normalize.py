"""The canonical event table: coercion, code splitting, validation, hash."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError

#: Canonical columns, in order, with their types: fixed names.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("subject_id", T.StringType()),
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("code", T.StringType()),
        T.StructField("code_system", T.StringType()),
        T.StructField("numeric_value", T.DoubleType()),
        T.StructField("text_value", T.StringType()),
        T.StructField("encounter_id", T.StringType()),
    ]
)
REQUIRED = ("subject_id", "time", "code")
BIRTH, DEATH = "MEDS_BIRTH", "MEDS_DEATH"
SEPARATOR = "//"

#: Accepted names of splits and what they stand for: fixed values.
SPLIT_ALIASES = {
    "train": "train",
    "training": "train",
    "tuning": "valid",
    "valid": "valid",
    "validation": "valid",
    "dev": "valid",
    "held_out": "test",
    "heldout": "test",
    "test": "test",
    "testing": "test",
    "eval": "test",
}


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENT_SCHEMA)


def lossy(column: Column, kind: T.DataType, source: T.DataType | None = None) -> Column:
    """A cast that gives null where a value does not fit.

    Whole floating-point numbers become text without a fraction, so that ids read as
    floats still match ids read as integers.
    """
    if isinstance(kind, T.StringType) and isinstance(source, (T.DoubleType, T.FloatType)):
        whole = column.try_cast("bigint")
        return F.when(whole.cast("double") == column, whole.cast("string")).otherwise(column.cast("string"))
    if isinstance(source, T.NullType):
        return F.lit(None).cast(kind)
    return column.try_cast(kind)


def coerce_events(df: DataFrame, group_column: str | None = None) -> DataFrame:
    """The seven canonical columns in order; missing optional ones are typed nulls.

    A declared ``group_column`` that is no canonical column is carried along as text.
    """
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise SchemaError(f"events lack required column(s) {', '.join(missing)}; found {', '.join(df.columns)}", column=missing[0])
    out = []
    for field in EVENT_SCHEMA.fields:
        have = field.name in df.columns
        value = lossy(F.col(field.name), field.dataType, df.schema[field.name].dataType) if have else F.lit(None).cast(field.dataType)
        out.append(value.alias(field.name))
    if group_column and group_column not in EVENT_SCHEMA.names and group_column in df.columns:
        out.append(lossy(F.col(group_column), T.StringType(), df.schema[group_column].dataType).alias(group_column))
    return df.select(*out)


def code_parts(code: Column) -> tuple[Column, Column]:
    """System and bare code, cut at the first separator; no separator: no system."""
    cut = F.instr(code, SEPARATOR)
    has = cut > 0
    return F.when(has, F.substr(code, F.lit(1), cut - 1)), F.when(has, F.substr(code, cut + len(SEPARATOR))).otherwise(code)


def split_code(df: DataFrame) -> DataFrame:
    system, bare = code_parts(F.col("code"))
    return df.withColumns({"code_system": system, "code": bare})


def timed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("time").isNotNull())


def static(df: DataFrame) -> DataFrame:
    return df.filter(F.col("time").isNull())


def subjects(df: DataFrame) -> DataFrame:
    return df.select("subject_id").filter("subject_id is not null").distinct().orderBy("subject_id")


def profile_columns() -> list[Column]:
    """Aggregates that answer every question about an event table's completeness."""
    none = lambda c: F.count_if(F.col(c).isNull())
    return [
        F.count("*").alias("n_events"),
        F.count_distinct("subject_id").alias("n_subjects"),
        *(none(c).alias(f"null_{c}") for c in ("subject_id", "code", "time", "code_system", "encounter_id")),
    ]


def warnings_of(p: dict) -> list[str]:
    """At most six warnings from :func:`profile_columns`; an empty table gives one."""
    n = p["n_events"]
    if not n:
        return ["the event table is empty"]
    out = []
    for column, note in (("subject_id", "they belong to nobody"), ("code", "they match no code"), ("time", "they count as static facts")):
        if p[f"null_{column}"]:
            out.append(f"{p[f'null_{column}']} of {n} events have no {column}; {note}")
    if p["null_code_system"] == n:
        out.append("no event has a code system; codes are matched by their bare value")
    if p["null_encounter_id"] == n:
        out.append("no event has an encounter id; checks that need one are skipped")
    return out


def events_hash(df: DataFrame) -> str:
    """16 hex digits that depend on the rows but not on their order."""
    row = F.xxhash64(*df.columns)
    got = df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()
    return hashlib.sha256("|".join(map(str, (*df.columns, *got))).encode()).hexdigest()[:16]


def canonical_split(column: Column) -> Column:
    """Trimmed, lower-cased and mapped by the aliases; unknown names stay as they are."""
    table = F.create_map(*(F.lit(x) for pair in SPLIT_ALIASES.items() for x in pair))
    return F.coalesce(table[F.lower(F.trim(column))], column)
