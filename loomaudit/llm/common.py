"""Shared storage, skew-safe joins and distributed connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session; only where that is unset and the
    session is on one machine, as in tests, a temporary folder is made and set.  A path without a
    scheme is one of the session's default file system.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="loomaudit-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", whole).rstrip("/")


_written: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, remembered in :func:`written`."""
    path = f"{shared_dir(spark)}/loomaudit/{name}-{uuid.uuid4().hex}"
    written(spark).append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Texts go to Python by so many at a time at most, in jobs that run inside; afterwards as the session has it.

    A batch of 10,000 texts takes its size several times over, in the JVM and in Python, for each core.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Hand memory that this process has freed back to the system; the allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``: workers live on for other tasks, so what its task took goes back when it ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def fewer(df: DataFrame, share: int = 8) -> DataFrame:
    """For results far smaller than what they are made of: one task, and file, for ``share`` partitions.

    At least four tasks a core stay; what has no more partitions than that is left alone.
    """
    now = df.rdd.getNumPartitions()
    least = max(4 * df.sparkSession.sparkContext.defaultParallelism, now // share)
    return df.coalesce(least) if now >= 2 * least else df


def written(spark: SparkSession) -> list[str]:
    """All scratch paths of this application so far, oldest first."""
    return _written.setdefault(spark.sparkContext.applicationId, [])


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables; whoever reads them must be done."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
        written(spark).remove(path)


def keep_last(spark: SparkSession, since: int) -> None:
    """Delete all scratch tables written since there were so many, but the last."""
    release(spark, written(spark)[since:-1])


def fresh_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join whose two sides are both dealt anew, so AQE can split a hot key.

    AQE splits a skewed partition only if both join inputs are plain shuffle
    reads.  An aggregate below the join would keep its own partitioning; wrapping
    the keys in a struct forces an exchange above it.  Null keys match null keys.
    """
    pack = lambda d: F.struct(*(d[k].alias(k) for k in keys))
    lhs = left.withColumn("__k", pack(left)).drop(*keys) if how == "inner" else left.withColumn("__k", pack(left))
    rhs = right.withColumn("__k", pack(right)).drop(*keys)
    if how == "inner":
        out = lhs.join(rhs, "__k", "inner")
        return out.select(*(F.col("__k")[k].alias(k) for k in keys), *(c for c in out.columns if c != "__k"))
    return lhs.join(rhs, "__k", how).drop("__k")


def told_apart(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows of ``id, t`` with a column ``th``, and their bytes of text.

    ``(id, th)`` names a text: ``th`` is a 64-bit hash of the text if any id is null or
    repeats, and zero if not.
    """
    size, n, kinds = rows.agg(F.sum(F.octet_length("t")), F.count("*"), F.count_distinct("id")).first()
    told = F.xxhash64("t") if n != kinds else F.lit(0).cast("bigint")
    return rows.withColumn("th", told), size or 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node for each node of an undirected graph.

    ``edges`` has two columns of one orderable type.  Alternating large-star and
    small-star steps (Kiveris et al., 2014) turn the edges into stars; every step
    is an aggregate with map-side minima and a splittable join, and is written to
    the shared folder.  Returns ``node, root`` for nodes that have an edge;
    an empty input gives an empty result.
    """
    a, b = edges.columns
    spark = edges.sparkSession
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    since = len(written(spark))
    links = materialise(links, "links")
    before = None
    for _ in range(rounds):
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = fresh_join(both, low, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = fresh_join(large, low, ["u"])
        small = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        links = materialise(small.filter("u <> v").distinct(), "links")
        keep_last(spark, since)  # the round's input and its first half
        stars, sum_u, sum_v, n, heads = links.agg(
            F.count_distinct("u"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v").cast("decimal(38,0)")), F.count("*"), F.lit(0)
        ).first()
        now = (n, sum_u, sum_v)
        if stars == n and now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
