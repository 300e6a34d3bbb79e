"""From raw documents to packed sequences, in five stages.

Each stage is a function of (session, documents, folder of the tables) that works on
all rows its predecessor kept; the result is written and read again.  Stages keep the
columns of ``documents`` and drop others; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomaudit.llm import common, queries
from loomaudit.llm.cotrain import classify, fit
from loomaudit.llm.decontam import clean
from loomaudit.llm.packing import pack
from loomaudit.llm.similar import near_copies as similar
from loomaudit.llm.substring import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_last: list[str] = []


def _begin(spark: SparkSession) -> int:
    """Delete the scratch tables of the stage before, which has been written by now."""
    common.release(spark, [p for p in _last if p in common.written(spark)])
    _last.clear()
    return len(common.written(spark))


def _end(spark: SparkSession, since: int) -> None:
    _last.extend(common.written(spark)[since:])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier finds neither poor nor toxic.

    Every row is judged by its own text and metadata, so rows without ids and rows with
    equal ids stand for themselves; a null text is an empty one; a target without labels
    of both kinds has no say.
    """
    since = _begin(spark)
    fitted, _ = fit(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = classify(docs.select(*COLUMNS), fitted)
    _end(spark, since)
    for target, kept in (("quality", F.col("quality") >= 0.5), ("toxic", F.col("toxic") < 0.5)):
        found = found.filter(kept) if target in fitted.views else found
    return found.select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each component of texts that share four fifths of their 5-word shingles.

    First is the smallest id (null last), then the smallest hash of the row, so rows
    without ids or with equal ids stand for themselves; of wholly equal rows one is kept.
    """
    since = _begin(spark)
    rows = docs.select(*COLUMNS, F.xxhash64(*(x for c in COLUMNS for x in (F.col(c), F.col(c).isNull()))).alias("__row"))
    found = similar(rows, row_col="__row")
    _end(spark, since)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    first = first.select(F.col("first.row").alias("__row")).distinct()
    return rows.join(first, "__row", "left_semi").dropDuplicates(["__row"]).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of 20 words that start earlier elsewhere; untouched texts stay as they are.

    A cut text has its words joined by single spaces and ``n_chars`` counted anew; it may
    be empty.  Null texts and ids pass; rows with equal id and text are one document.
    """
    since = _begin(spark)
    found = remove_repeats(docs, carry=("text", "lang", "source", "n_chars"))
    _end(spark, since)
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept")).otherwise(F.col("row.text"))
    size = F.when(cut, F.char_length("kept").cast("bigint")).otherwise(F.col("row.n_chars"))
    return found.select(F.col("id").alias("doc_id"), text.alias("text"), "row.lang", "row.source", size.alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null texts have none, and ids do not matter."""
    since = _begin(spark)
    left = clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    _end(spark, since)
    return left


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, with their token ids; a null text is its end token."""
    since = _begin(spark)
    found = pack(docs, queries._vocabulary())
    _end(spark, since)
    return found.withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("decontaminate", decontaminate), ("packing", packing)]

#: The first stage fits a classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = common.scratch_path(spark, f"stage-{name}")
            common.written(spark).remove(path)  # the next stage reads it, so no stage may delete it
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
