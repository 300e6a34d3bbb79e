"""Splits as a long relation (subject_id, split)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SplitsError
from ..functions.normalize import canonical_split

SCHEMA = "subject_id string, split string"
ORDER = ("train", "valid", "test")


def normalise(frame: DataFrame) -> DataFrame:
    """Canonical names, text ids, no nulls, no repeats."""
    if "subject_id" not in frame.columns or "split" not in frame.columns:
        raise SplitsError(f"splits need the columns subject_id and split; found {', '.join(frame.columns)}")
    out = frame.select(F.col("subject_id").cast("string").alias("subject_id"), canonical_split(F.col("split").cast("string")).alias("split"))
    return out.filter("subject_id is not null and split is not null").distinct()


def splits_from_mapping(spark: SparkSession, mapping: dict) -> DataFrame:
    if not isinstance(mapping, dict) or not mapping:
        raise SplitsError("splits must be a non-empty mapping of names to lists of subjects")
    rows = []
    for name, members in mapping.items():
        if not isinstance(members, (list, tuple, set)):
            raise SplitsError(f"split {name!r} must be a list of subjects, found {type(members).__name__}")
        rows += [(None if m is None else str(m), str(name)) for m in members]
    return normalise(spark.createDataFrame(rows, SCHEMA))


def read_splits(spark: SparkSession, path, id_map: DataFrame | None = None) -> DataFrame:
    """JSON object of lists, or Parquet; an id map must cover every subject."""
    if isinstance(path, DataFrame):
        return normalise(path)
    if isinstance(path, dict):
        return splits_from_mapping(spark, path)
    if str(path).endswith(".json"):
        try:
            text = "\n".join(r.value for r in spark.read.text(str(path)).collect())  # a driver-side document
            frame = splits_from_mapping(spark, json.loads(text))
        except ValueError as error:
            raise SplitsError(f"{path} is no JSON object of lists: {error}") from error
    else:
        frame = normalise(spark.read.parquet(str(path)))
    if id_map is None:
        return frame
    from .meds import restore_ids

    return restore_ids(frame, id_map, "splits", or_original=True)


def write_json(splits: DataFrame, path) -> None:
    """One list a split, train, valid and test first; for splits that fit the driver."""
    from pathlib import Path

    found: dict[str, list] = {}
    for r in splits.orderBy("split", "subject_id").toLocalIterator():
        found.setdefault(r.split, []).append(r.subject_id)
    names = [n for n in ORDER if n in found] + sorted(set(found) - set(ORDER))
    Path(path).write_text(json.dumps({n: found[n] for n in names}, indent=2))


def overlaps(splits: DataFrame) -> DataFrame:
    """Subjects shared by each pair of splits: ``a, b, n_shared``."""
    per = splits.groupBy("subject_id").agg(F.array_sort(F.collect_set("split")).alias("s")).filter(F.size("s") > 1)
    pairs = per.select(F.posexplode("s").alias("i", "a"), "s").select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n_shared"))


def split_of(splits: DataFrame) -> DataFrame:
    """``subject_id, splits``: the splits of each subject, train, valid and test first."""
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("split"))
    place = F.struct(F.when(rank > 0, rank).otherwise(len(ORDER) + 1).alias("r"), F.col("split").alias("s"))
    return splits.groupBy("subject_id").agg(F.array_sort(F.collect_set(place)).alias("p")).select("subject_id", F.col("p.s").alias("splits"))


def all_subjects(splits: DataFrame) -> DataFrame:
    return splits.select("subject_id").distinct()


def describe(splits: DataFrame, source: str | None = None) -> dict:
    """For the report's header: names, sizes, subjects and pairs of splits that overlap."""
    found = {r.split: r.n_subjects for r in sizes(splits).collect()}  # a handful of splits
    names = [n for n in ORDER if n in found] + sorted(set(found) - set(ORDER))
    return {"source": source, "names": names, "sizes": {n: found[n] for n in names}, "n_subjects": all_subjects(splits).count(), "n_overlapping_pairs": overlaps(splits).count()}


def sizes(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split").agg(F.count_distinct("subject_id").alias("n_subjects"))
