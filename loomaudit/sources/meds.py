"""MEDS datasets: event shards, id maps, metadata; reading and writing."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InputError, SchemaError
from ..functions.normalize import REQUIRED, coerce_events, code_parts, lossy
from .files import exists, is_folder, read_text, walk, write_text

#: Encounter columns in order of preference: fixed names.
ENCOUNTER_NAMES = ("encounter_id", "visit_id", "hadm_id", "visit_occurrence_id")
ID_MAP = "metadata/subject_id_map.parquet"
SPLITS = "metadata/subject_splits.parquet"
#: Splits as the format names them: fixed values.
MEDS_SPLITS = {"train": "train", "valid": "tuning", "test": "held_out"}


def find_shards(root: str) -> list[str]:
    """Shards below data/, else at the top, else anywhere but in metadata/."""
    root = str(root).rstrip("/")
    if not is_folder(root):
        if exists(root):
            return [root]
        raise InputError(f"no MEDS dataset at {root}", path=root)
    found = walk(f"{root}/data", ".parquet")
    every = walk(root, ".parquet")
    own = [p for p in every if "/" not in p.split(root.split(":", 1)[-1].lstrip("/"), 1)[-1].strip("/")]
    found = found or own or [p for p in every if "/metadata/" not in p]
    if not found:
        raise InputError(f"no Parquet shard below {root}", path=root)
    return found


def frame_to_canonical(df: DataFrame, encounter_column: str | None = None, group_column: str | None = None) -> DataFrame:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise SchemaError(f"the shard lacks {', '.join(missing)}; found {', '.join(df.columns)}", column=missing[0])
    if encounter_column is not None and encounter_column not in df.columns:
        raise SchemaError(f"the shard has no encounter column {encounter_column}", column=encounter_column)
    encounter = encounter_column or next((c for c in ENCOUNTER_NAMES if c in df.columns), None)
    system, code = code_parts(lossy(F.col("code"), T.StringType(), df.schema["code"].dataType))
    if "code_system" in df.columns:
        system = F.coalesce(system, F.col("code_system").cast("string"))
    df = df.withColumns({"code": code, "code_system": system})
    if encounter and encounter != "encounter_id":
        df = df.withColumn("encounter_id", F.col(encounter))
    return coerce_events(df, group_column)


def read_meds_events(spark: SparkSession, root: str, encounter_column: str | None = None, group_column: str | None = None) -> DataFrame:
    """All shards as canonical events with original ids.

    Shards of one schema are read together; each distinct schema is made canonical
    before the union, so types that drift between shards meet as text or doubles.
    """
    by_schema = shard_schemas(spark, root)
    parts = [frame_to_canonical(spark.read.parquet(*paths), encounter_column, group_column) for paths in by_schema.values()]
    events = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return restore_ids(events, read_subject_id_map(spark, root) if is_folder(root) else None, "events")


def shard_schemas(spark: SparkSession, root: str, at_once: int = 32) -> dict[str, list[str]]:
    """Shards by their schema (as JSON); footers are read ``at_once`` at a time, not one after another."""
    paths, out = find_shards(root), {}
    with ThreadPoolExecutor(at_once) as pool:
        for path, schema in zip(paths, pool.map(lambda p: _schema_of(spark, p), paths)):
            out.setdefault(schema, []).append(path)
    return out


def _schema_of(spark: SparkSession, path: str) -> str:
    try:
        return spark.read.parquet(path).schema.json()
    except Exception as error:
        if "PARQUET_TYPE_ILLEGAL" in str(error):
            raise InputError(f"{path} holds a type that Spark cannot read, such as nanosecond timestamps; write microseconds", path=path) from error
        raise


def read_subject_id_map(spark: SparkSession, root: str) -> DataFrame | None:
    path = f"{str(root).rstrip('/')}/{ID_MAP}"
    if not exists(path):
        return None
    df = spark.read.parquet(path)
    for c in ("subject_id", "original_subject_id"):
        if c not in df.columns:
            raise InputError(f"the subject id map {path} has no column {c}", path=path, column=c)
    return df.select(F.col("subject_id").cast("string").alias("subject_id"), F.col("original_subject_id").cast("string").alias("original_subject_id"))


def restore_ids(df: DataFrame, id_map: DataFrame | None, what: str, or_original: bool = False) -> DataFrame:
    """Original ids for surrogates; an id that the map lacks is an error.

    With ``or_original``, ids that are originals already stay as they are: side files
    come with either.
    """
    if id_map is None:
        return df
    pairs = id_map.select(F.col("subject_id").alias("__s"), F.col("original_subject_id").alias("__o"))
    if or_original:
        pairs = pairs.unionByName(id_map.select(F.col("original_subject_id").alias("__s"), F.col("original_subject_id").alias("__o"))).distinct()
    joined = df.join(pairs, F.col("subject_id") == F.col("__s"), "left")
    lost = joined.filter("subject_id is not null and __o is null").agg(F.count("*"), F.min("subject_id")).first()
    if lost[0]:
        raise InputError(f"{lost[0]} row(s) of {what} have subjects that the id map lacks, such as {lost[1]}")
    return joined.select(*(F.col("__o").alias(c) if c == "subject_id" else c for c in df.columns))


def read_dataset_metadata(root: str) -> dict:
    path = f"{str(root).rstrip('/')}/metadata/dataset.json"
    if not exists(path):
        return {}
    try:
        out = json.loads(read_text(path))
    except ValueError as error:
        raise InputError(f"{path} is no JSON: {error}", path=path) from error
    if not isinstance(out, dict):
        raise InputError(f"{path} holds no JSON object", path=path)
    return out


def read_code_metadata(spark: SparkSession, root: str) -> DataFrame | None:
    path = f"{str(root).rstrip('/')}/metadata/codes.parquet"
    return spark.read.parquet(path) if exists(path) else None


def find_splits(root: str) -> str | None:
    path = f"{str(root).rstrip('/')}/{SPLITS}"
    return path if is_folder(root) and exists(path) else None


#: Data schema of the format: fixed names and types.
MEDS_SCHEMA = {"subject_id": "bigint", "time": "timestamp_ntz", "code": "string", "numeric_value": "float", "text_value": "string"}


def schema_warnings(df: DataFrame) -> list[str]:
    """How a frame departs from the format's schema."""
    kinds = dict(df.dtypes)
    out = [f"column {c} is missing" for c in REQUIRED if c not in kinds]
    return out + [f"column {c} is {kinds[c]}, the format has {t}" for c, t in MEDS_SCHEMA.items() if c in kinds and kinds[c] != t]


def subject_id_surrogates(events: DataFrame) -> DataFrame | None:
    """``subject_id, original_subject_id``: 1 .. n in sorted order; none if all ids are integers.

    Ranks come from a range-partitioned sort with counts of the partitions before, so no
    single task holds all ids.
    """
    ids = events.select(F.col("subject_id").alias("original_subject_id")).filter("original_subject_id is not null").distinct()
    number = F.col("original_subject_id").try_cast("bigint")
    if ids.filter(number.isNull() | (number.cast("string") != F.col("original_subject_id"))).isEmpty():
        return None
    placed = ids.repartitionByRange("original_subject_id").sortWithinPartitions("original_subject_id").withColumn("__p", F.spark_partition_id()).persist()
    sizes = placed.groupBy("__p").agg(F.count("*").alias("n"))
    before = sizes.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("before"))  # one row a partition
    rank = F.row_number().over(Window.partitionBy("__p").orderBy("original_subject_id"))
    out = placed.withColumn("r", rank).join(F.broadcast(before), "__p")
    return out.select((F.col("r") + F.col("before")).cast("bigint").alias("subject_id"), "original_subject_id")


def apply_surrogates(df: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Integer ids; an id that gets none is an error, not a null."""
    if ids is None:
        out = df.withColumn("__n", F.col("subject_id").try_cast("bigint"))
    else:
        out = df.join(ids.select(F.col("subject_id").alias("__n"), "original_subject_id"), F.col("subject_id") == F.col("original_subject_id"), "left").drop("original_subject_id")
    if lost := out.filter("subject_id is not null and __n is null").count():
        raise InputError(f"{lost} row(s) would lose their subject id")
    return out.withColumn("subject_id", F.col("__n")).drop("__n")


def write_meds_dataset(events: DataFrame, out: str, name: str, splits: DataFrame | None = None, version: str = "1.0") -> None:
    """Shards with namespaced codes, single-precision values and integer ids, and the side files."""
    out = str(out).rstrip("/")
    ids = subject_id_surrogates(events)
    numbered = apply_surrogates(events, ids)
    code = F.when(F.col("code_system").isNotNull(), F.concat("code_system", F.lit("//"), "code")).otherwise(F.col("code"))
    shaped = numbered.select("subject_id", "time", code.alias("code"), F.col("numeric_value").cast("float").alias("numeric_value"), "text_value", "encounter_id")
    shaped.write.mode("overwrite").parquet(f"{out}/data")
    if ids is not None:
        ids.select("original_subject_id", "subject_id").write.mode("overwrite").parquet(f"{out}/{ID_MAP}")
    if splits is not None:
        names = F.create_map(*(F.lit(x) for pair in MEDS_SPLITS.items() for x in pair))
        named = apply_surrogates(splits, ids).select("subject_id", F.coalesce(names[F.col("split")], "split").alias("split"))
        named.write.mode("overwrite").parquet(f"{out}/{SPLITS}")
    meta = {"dataset_name": name, "dataset_version": version, "etl_name": "loomaudit", "etl_version": "0.1.0", "meds_version": "0.3.3"}
    write_text(f"{out}/metadata/dataset.json", json.dumps(meta, indent=2))
