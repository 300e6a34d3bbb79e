"""OMOP CDM extracts as canonical events."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError, SchemaError
from ..functions.normalize import BIRTH, EVENT_SCHEMA, empty_events, lossy
from .files import exists, is_folder

UNMAPPED = "0"
VISIT = "visit_occurrence_id"


@dataclass(frozen=True)
class OmopTable:
    """Columns of one clinical table; times in order of preference."""

    name: str
    times: tuple[str, ...]
    code: str
    system: str
    source: str
    numeric: str | None = None
    text: str | None = None


#: Columns of the OMOP common data model: fixed names.
SPECS = {
    t.name: t
    for t in (
        OmopTable("condition_occurrence", ("condition_start_datetime", "condition_start_date"), "condition_concept_id", "OMOP_CONDITION", "condition_source_value"),
        OmopTable("drug_exposure", ("drug_exposure_start_datetime", "drug_exposure_start_date"), "drug_concept_id", "OMOP_DRUG", "drug_source_value", "quantity"),
        OmopTable("measurement", ("measurement_datetime", "measurement_date"), "measurement_concept_id", "OMOP_MEASUREMENT", "measurement_source_value", "value_as_number", "value_source_value"),
        OmopTable("procedure_occurrence", ("procedure_datetime", "procedure_date"), "procedure_concept_id", "OMOP_PROCEDURE", "procedure_source_value"),
        OmopTable("observation", ("observation_datetime", "observation_date"), "observation_concept_id", "OMOP_OBSERVATION", "observation_source_value", "value_as_number", "value_as_string"),
        OmopTable("visit_occurrence", ("visit_start_datetime", "visit_start_date"), "visit_concept_id", "OMOP_VISIT", "visit_source_value"),
    )
}
PERSON_FACTS = {"gender_concept_id": "OMOP_GENDER", "race_concept_id": "OMOP_RACE", "ethnicity_concept_id": "OMOP_ETHNICITY", "year_of_birth": "OMOP_BIRTH_YEAR"}


def _typed(df: DataFrame, column: str | None, field: str):
    kind = EVENT_SCHEMA[field].dataType
    if column is None or column not in df.columns:
        return F.lit(None).cast(kind)
    return lossy(F.col(column), kind, df.schema[column].dataType)


def _need_person(df: DataFrame, table: str) -> None:
    if "person_id" not in df.columns:
        raise SchemaError(f"OMOP table {table} has no person_id; found {', '.join(df.columns)}", table=table, column="person_id")


def _lower(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.lower() for c in df.columns))


def convert_table(df: DataFrame, spec: OmopTable) -> DataFrame:
    """Events of one table; concept 0 or null falls back to the source value and its system."""
    df = _lower(df)
    _need_person(df, spec.name)
    time = F.coalesce(*(_typed(df, c, "time") for c in spec.times))
    concept = _typed(df, spec.code, "code")
    mapped = concept.isNotNull() & (concept != UNMAPPED)
    code = F.when(mapped, concept).otherwise(_typed(df, spec.source, "code"))
    system = F.when(mapped, F.lit(spec.system)).otherwise(F.lit(f"{spec.system}_SOURCE"))
    out = df.select(
        _typed(df, "person_id", "subject_id").alias("subject_id"),
        time.alias("time"),
        code.alias("code"),
        system.alias("code_system"),
        _typed(df, spec.numeric, "numeric_value").alias("numeric_value"),
        _typed(df, spec.text, "text_value").alias("text_value"),
        _typed(df, VISIT, "encounter_id").alias("encounter_id"),
    )
    return out.filter("code is not null and time is not null")


def convert_person(df: DataFrame) -> DataFrame:
    """Static facts, and a timed birth where the moment of birth is known."""
    df = _lower(df)
    _need_person(df, "person")
    none = lambda f: F.lit(None).cast(EVENT_SCHEMA[f].dataType).alias(f)
    fact = lambda code, system, time: F.struct(time.alias("time"), code.alias("code"), F.lit(system).cast("string").alias("code_system"))
    never = F.lit(None).cast("timestamp_ntz")
    facts = [fact(_typed(df, c, "code"), s, never) for c, s in PERSON_FACTS.items()]
    birth = _typed(df, "birth_datetime", "time")
    facts.append(fact(F.when(birth.isNotNull(), F.lit(BIRTH)), None, birth))
    rows = df.select(_typed(df, "person_id", "subject_id").alias("subject_id"), F.explode(F.array(*facts)).alias("f"))
    rows = rows.select("subject_id", "f.time", "f.code", "f.code_system", none("numeric_value"), none("text_value"), none("encounter_id"))
    return rows.filter(F.col("code").isNotNull() & (F.col("code") != UNMAPPED))


def _find(spark: SparkSession | None, root: str, name: str) -> tuple[str, str] | None:
    for spelling in (name, name.upper(), name.capitalize()):
        for kind in ("parquet", "csv"):
            if exists(path := f"{root}/{spelling}.{kind}"):
                return path, kind
        if is_folder(path := f"{root}/{spelling}"):
            return path, "parquet"
    return None


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    found = _find(spark, str(root).rstrip("/"), name)
    if found is None:
        return None
    path, kind = found
    return spark.read.parquet(path) if kind == "parquet" else spark.read.csv(path, header=True, inferSchema=False)  # as text: 007 stays 007, and no second scan


def tables_present(root: str) -> list[str]:
    return [n for n in (*SPECS, "person") if _find(None, str(root).rstrip("/"), n)]


def read_omop_events(spark: SparkSession, root: str, include_person: bool = True) -> DataFrame:
    parts = [convert_table(df, spec) for name, spec in SPECS.items() if (df := read_table(spark, root, name)) is not None]
    if include_person and (person := read_table(spark, root, "person")) is not None:
        parts.append(convert_person(person))
    if not parts:
        raise InputError(f"no OMOP table in {root}; looked for {', '.join((*SPECS, 'person'))}", path=root)
    return reduce(DataFrame.unionByName, parts, empty_events(spark))
