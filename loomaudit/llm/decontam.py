"""Benchmark decontamination by a prefix-filtered set join.

An item gives windows of ``k`` consecutive words, or one window of all its words
if it has fewer.  A document is searched for each window as follows.

* *Order by rarity.*  A window is a set of shingles of up to three words.  One
  pass over all documents counts the shingles that occur in items.
* *Prefix.*  Containment of a whole window needs every shingle, so the prefix that
  must be met is its rarest shingle alone.  Only prefixes are joined with the
  documents' shingles; a window with a shingle that no document has is dropped.
* *Bounds.*  A prefix met at a position fixes the window's start; it must lie in
  the document, and so must the window's end.
* *Verification.*  Documents with candidates are read again, and the words of each
  candidate must be those of the item-sized window, byte by byte.

Both sides are tables, so neither the benchmark nor its windows need fit anywhere.
What is broadcast are two Bloom filters of at most ``filter_bytes`` each, of the
items' shingles and of the prefixes; they only spare rows from being shuffled.  A
third one, of the documents with candidates, spares all other texts.  Frequent
prefixes are joined with both sides dealt anew, so AQE can split them.

Defined cases: null and empty texts have no words and no hits; an item without
words has no window; repeated items and rows count each; equal ``item_id`` of
several items is one id; null ``item_id`` is left out of the list of items though
its windows count; a null ``doc_id`` is passed through, and rows with equal or null
ids are told apart by a 64-bit hash of their text; of equally rare shingles the one
with the smallest hash, then offset, is the prefix; a long text is one run of words
and needs its task's memory about forty times; an empty benchmark gives no hits and
an empty table an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, segments
from . import textscan as ts

SHINGLE = 3


def _words(raw: np.ndarray, at: np.ndarray) -> ts.Words:
    return ts.Words(ts.LOWER[raw], at, ts.NON_WORD)


def _windows(k: int):
    """Windows of each item: width, words joined by spaces, and the hashes of its shingles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in ts.chunks(batch, "t"):
                words = _words(raw, at)
                hashes, counts = words.hashes(), words.counts
                buf, lo, hi = ts.single_spaced(words)
                for size in range(1, k + 1):
                    owner = np.flatnonzero(counts >= k if size == k else counts == size)
                    each = counts[owner] - size + 1
                    if not len(owner):
                        continue
                    doc = np.repeat(owner, each)
                    first = words.first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
                    g = min(size, SHINGLE)
                    n = size - g + 1
                    grams = ts.gram_hashes(hashes, g)[first[:, None] + np.arange(n)]
                    text = [buf[a:b].tobytes() for a, b in zip(lo[first].tolist(), hi[first + size - 1].tolist())]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(doc) + 1, dtype=np.int32) * n), pa.array(grams.ravel().view(np.int64)))
                    arrays = [part.column(0).take(pa.array(doc)), pa.array(np.full(len(doc), size, np.int32)), pa.array(text, pa.binary()).cast(pa.string()), lists]
                    yield pa.RecordBatch.from_arrays(arrays, ["item", "width", "win", "shingles"])

    return run


def _counted(sent, seg_bits: int, sizes: list[int], bits: int):
    """Packed runs of the documents' shingles that may be in items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = segments.Packer(bits)
        for batch in batches:
            for _, raw, at in ts.chunks(batch, "t"):
                words = _words(raw, at)
                hashes = words.hashes()
                for g in sizes:
                    grams = ts.gram_hashes(hashes, g)[ts.inside_mask(words.counts, g)]
                    yield from packer.add(grams[segments.bloom_probe(sent.value, seg_bits, grams, 3)])
        yield from packer.flush()

    return run


def _tallied(seg: int, table: pa.Table) -> pa.Table:
    values, counts = segments.merge(table)
    return pa.table({"h": pa.array(values.view(np.int64)), "n": pa.array(counts)})


def _met(sent, seg_bits: int, sizes: list[int]):
    """Words of each text, and where its shingles may be prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in ts.chunks(batch, "t"):
                words = _words(raw, at)
                hashes, counts = words.hashes(), words.counts
                places, values = [np.zeros(0, np.int64)], [np.zeros(0, ts.U)]
                for g in sizes:
                    grams = ts.gram_hashes(hashes, g)
                    pos = np.flatnonzero(ts.inside_mask(counts, g))
                    pos = pos[segments.bloom_probe(sent.value, seg_bits, grams[pos], 3)] if len(pos) else pos
                    places.append(pos)
                    values.append(grams[pos])
                place, value = np.concatenate(places), np.concatenate(values)
                order = np.argsort(place, kind="stable")
                place, value = place[order], value[order]
                ends = np.searchsorted(place, words.first)
                local = place - np.repeat(words.first[:-1], np.diff(ends))
                hits = pa.StructArray.from_arrays([pa.array(value.view(np.int64)), pa.array(local.astype(np.int32))], ["h", "at"])
                hits = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), hits)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts.astype(np.int64)), hits], ["id", "th", "n_words", "hits"])

    return run


def _verified():
    """Spans that are windows of items indeed, and these windows, of texts with candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in ts.chunks(batch, "t"):
                words = _words(raw, at)
                buf, lo, hi = ts.single_spaced(words)
                view, out = memoryview(buf), []
                for d, found in enumerate(part.column(3).to_pylist()):
                    base, spans, wins = int(words.first[d]), [], set()
                    for c in sorted(found, key=lambda c: (c["at"], c["width"])):
                        a = base + c["at"]
                        b = a + c["width"]
                        if view[lo[a] : hi[b - 1]] != c["win"].encode():
                            continue
                        wins.add(c["win"])
                        if spans and c["at"] <= spans[-1]["end"]:
                            spans[-1]["end"] = max(spans[-1]["end"], b - base)
                        else:
                            spans.append({"start": c["at"], "end": b - base})
                    out.append((spans, sorted(wins)))
                spans, wins = zip(*out)
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                arrays = [part.column(0), part.column(1), pa.array(spans, kind), pa.array(wins, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "th", "spans", "wins"])

    return run


def _found(rows: DataFrame, size: int, benchmark: DataFrame, k: int, filter_bytes: int, item_col: str, item_text: str) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """All rows with their words, those with verified spans, and the windows of items."""
    spark = rows.sparkSession
    kind = rows.schema["id"].dataType.simpleString()
    send = spark.sparkContext.broadcast
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t"))
    every = common.materialise(items.mapInArrow(common.lean(_windows(k)), "item string, width int, win string, shingles array<bigint>"), "windows")
    windows = every.groupBy("win").agg(F.min("width").alias("width"), F.min("shingles").alias("shingles"))
    windows = common.materialise(windows, "distinct-windows")
    n, widths = windows.agg(F.sum(F.size("shingles")), F.collect_set("width")).first()  # at most k widths
    sizes = sorted({min(w, SHINGLE) for w in widths})

    seg_bits = 6
    flat = windows.select(F.explode("shingles").alias("h")).mapInArrow(common.lean(segments.pack_longs(seg_bits)), segments.SCHEMA)
    known = send(segments.bloom_filter(flat, 1, segments.filter_bytes(n or 0, filter_bytes, seg_bits), seg_bits))
    bits = segments.segment_bits(size)
    packed = rows.select("t").mapInArrow(common.lean(_counted(known, seg_bits, sizes, bits)), segments.SCHEMA)
    frequency = common.materialise(segments.by_segment(packed, _tallied, "h bigint, n bigint"), "frequency")

    placed = windows.select("win", "width", F.posexplode("shingles").alias("offset", "h"))
    ranked = common.fresh_join(placed, frequency, ["h"]).groupBy("win", "width").agg(F.min(F.struct("n", "h", "offset")).alias("best"), F.count("*").alias("c"))
    ranked = ranked.filter(F.col("c") == F.col("width") - F.least("width", F.lit(SHINGLE)) + 1)
    prefix = common.materialise(ranked.select("best.h", "best.offset", "width", "win"), "prefixes")
    first = prefix.select("h").distinct()
    heads = send(segments.bloom_filter(first.mapInArrow(common.lean(segments.pack_longs(seg_bits)), segments.SCHEMA), 1, segments.filter_bytes(first.count(), filter_bytes, seg_bits), seg_bits))
    schema = f"id {kind}, th bigint, n_words bigint, hits array<struct<h:bigint,at:int>>"
    met = common.materialise(rows.select("id", "th", "t").mapInArrow(common.lean(_met(heads, seg_bits, sizes)), schema), "met")

    one = met.filter(F.size("hits") > 0).groupBy("id", "th").agg(F.max("n_words").alias("n_words"), F.max("hits").alias("hits"))
    place = one.select("id", "th", "n_words", F.explode("hits").alias("x")).select("id", "th", "n_words", "x.h", "x.at")
    start = F.col("at") - F.col("offset")
    joined = common.fresh_join(place, prefix, ["h"]).filter((start >= 0) & (start + F.col("width") <= F.col("n_words")))
    where = F.struct(start.cast("int").alias("at"), "width", "win")
    asked = common.materialise(joined.select("id", "th", where.alias("c")).groupBy("id", "th").agg(F.collect_set("c").alias("cs")), "candidates")
    key = F.xxhash64("id", "th")
    texts = rows.select("id", "th", "t").filter(segments.may_be_among(rows, key, asked.select(key.alias("key")), filter_bytes)).dropDuplicates(["id", "th"])
    same = texts["id"].eqNullSafe(asked["id"]) & (texts["th"] == asked["th"])
    checked = texts.join(asked, same).select(texts["id"], texts["th"], "t", "cs")
    spans = checked.mapInArrow(common.lean(_verified()), f"id {kind}, th bigint, spans array<struct<start:int,end:int>>, wins array<string>")
    return met, common.materialise(spans.filter(F.size("spans") > 0), "verified"), every


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return common.told_apart(docs.select(F.col(id_col).alias("id"), text.alias("t")))


def contamination(
    docs: DataFrame, benchmark: DataFrame, k: int = 10, filter_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``id, n_words, n_hit, spans, items`` of each document.

    ``spans`` are ranges of words that lie in an occurrence of an item's window,
    ``items`` the ids of items with a window in the document, sorted as strings.
    """
    rows, size = _rows(docs, id_col, text_col)
    met, spans, every = _found(rows, size, benchmark, k, filter_bytes, item_col, item_text)
    owners = every.filter("item is not null").select("win", "item").distinct()
    listed = common.fresh_join(spans.select("id", "th", F.explode("wins").alias("win")), owners, ["win"])
    listed = listed.groupBy("id", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = common.fresh_join(spans.select("id", "th", "spans"), listed, ["id", "th"], "left")
    out = common.fresh_join(met.select("id", "th", "n_words"), found, ["id", "th"], "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    none = F.array().cast("array<struct<start:int,end:int>>")
    return out.select(
        "id", "n_words", F.coalesce(n_hit, F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def clean(
    docs: DataFrame, benchmark: DataFrame, k: int = 10, filter_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` without a window of any item, in all their columns.

    Only texts that the filter of contaminated documents lets through are shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows, size = common.told_apart(docs.select(F.col(id_col).alias("id"), text.alias("t"), F.struct(*(F.col(c) for c in docs.columns)).alias("row")))
    _, spans, _ = _found(rows.select("id", "t", "th"), size, benchmark, k, filter_bytes, item_col, item_text)
    bad = spans.select("id", "th")
    rows = rows.select("id", "th", "row")
    marked = rows.withColumn("maybe", segments.may_be_among(rows, F.xxhash64("id", "th"), bad.select(F.xxhash64("id", "th").alias("key")), filter_bytes))
    hot = marked.filter("maybe")
    left = hot.join(bad, hot["id"].eqNullSafe(bad["id"]) & (hot["th"] == bad["th"]), "left_anti")
    return marked.filter("not maybe").unionByName(left).select("row.*")
