"""Removal of repeated word windows through a compacted De Bruijn graph.

Every window of ``k`` consecutive words is an edge between its first and its last
``k - 1`` words.  The steps:

1. *Edges.*  Edges are dealt by their minimizer, the smallest hash of ``m`` words
   inside them.  Consecutive edges of a text with one minimizer form one
   nonbranching piece of path, kept as one row: minimizer, 64-bit hash of all its
   words, document and start.  About one row remains of eight windows.
2. *Filter.*  A first pass counts minimizers; those met more than once go into a
   Bloom filter of fixed size that is broadcast.  It only saves work: a false
   positive costs a row, nothing depends on it.
3. *Compaction.*  Equal pieces (minimizer and hash of all words) are one path with
   its smallest source coordinate (document, start); joined back, every other
   occurrence goes as a whole.
4. *Branches.*  Where a minimizer has different pieces, or a piece repeats an edge
   within itself, paths branch.  Only there, and only for the first occurrence of
   each piece, edges are listed one by one, grouped, and settled by their smallest
   coordinate.  A second filter of fixed size picks these pieces while scanning.
5. *Coordinates.*  Every window to remove knows the coordinate it repeats.  Windows
   of a text with one source document and one distance to it merge into long spans.
   Each source text yields a 128-bit digest of the words of each span asked of it; the
   digests travel to the texts that lose the span, where the words must have the same.

Two different spans would have to share two independent 64-bit hashes (minimizer, and
piece or edge) to be taken for equal; if that ever happens the digests differ and the
job raises :class:`Collision`, to be run again with another ``seed``.  Windows are
judged on the input.  Only words inside a repeated window go.

Defined cases: a null text has no words; a text shorter than ``k`` words loses
none; rows with equal id and text are one document (both keep or lose the same
words); rows with equal id and different texts are told apart by a 64-bit hash of the
text, which is carried only if ids repeat or are null; a null id sorts first; an empty
table gives an empty result; other columns are ignored, whatever their names.  One text
must fit a task's memory about forty times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, segments
from . import textscan as ts


class Collision(RuntimeError):
    """Two different spans had equal hashes; run again with another seed."""


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, size = x, 1
    while size * 2 <= width:
        out, size = np.minimum(out[:-size], out[size:]), size * 2
    return np.minimum(out[: len(x) - width + 1], out[width - size :]) if width > size else out


def _pieces(words: ts.Words, k: int, m: int, seed: int):
    """Pieces of one run of texts: text index, first window, windows, minimizer, whether an edge may repeat inside."""
    hashes, counts = words.hashes(seed), words.counts
    none = np.zeros(0, np.int64)
    if len(hashes) < k:
        return hashes, none, none, none, np.zeros(0, ts.U), np.zeros(0, bool)
    grams = ts.gram_hashes(hashes, m)
    low = _sliding_min(grams, k - m + 1)
    at = np.flatnonzero(ts.inside_mask(counts, k))
    if not len(at):
        return hashes, none, none, none, np.zeros(0, ts.U), np.zeros(0, bool)
    doc = words.doc()[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[at[1:]] != low[at[:-1]]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(at)))
    piece_of = np.full(len(low), -1, np.int64)
    piece_of[at] = np.cumsum(new) - 1
    twice = np.zeros(len(head), bool)
    reach = k - m + 1
    for d in range(1, reach + 1):
        p = np.flatnonzero(grams[:-d] == grams[d:])
        for back in range(reach):
            j = p - back
            ok = j[(j >= 0) & (j < len(low))]
            v = grams[ok + back]
            hit = ok[(low[ok] == v) & (piece_of[ok] >= 0)]
            twice[piece_of[hit]] = True
    return hashes, doc[head], at[head], size, low[at[head]], twice


def _packed(k: int, m: int, seed: int, bits: int):
    """Minimizers of all pieces, twice where an edge may repeat inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = segments.Packer(bits)
        for batch in batches:
            for _, raw, at in ts.chunks(batch, "t"):
                _, _, _, _, low, twice = _pieces(ts.Words(raw, at), k, m, seed)
                yield from packer.add(np.concatenate([low, low[twice]]))
        yield from packer.flush()

    return run


def _place(doc_key: np.ndarray, mini: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hash of a piece's place, for the filter of first occurrences."""
    return ts.mix(doc_key ^ ts.mix(mini ^ ts.mix(start.astype(ts.U))))


def _known(words: ts.Words, k: int, m: int, seed: int, bits: np.ndarray, seg_bits: int):
    """Pieces whose minimizer may be met again, as :func:`_pieces` gives them."""
    hashes, *rest = _pieces(words, k, m, seed)
    keep = np.flatnonzero(segments.bloom_probe(bits, seg_bits, rest[3], 3))
    return hashes, *(x[keep] for x in rest)


def _occurrences(k: int, m: int, seed: int, known, seg_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in ts.chunks(batch, "t"):
                words = ts.Words(raw, at)
                hashes, doc, start, size, low, twice = _known(words, k, m, seed, known.value, seg_bits)
                whole = ts.span_hashes(hashes, start, size + k - 1)
                local = start - words.first[:-1][doc]
                owner = pa.array(doc)
                arrays = [pa.array(low.view(np.int64)), pa.array(whole.view(np.int64)), part.column(0).take(owner), part.column(1).take(owner)]
                arrays += [pa.array(local.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(twice)]
                yield pa.RecordBatch.from_arrays(arrays, ["mini", "whole", "id", "th", "at", "n", "twice"])

    return run


def _pack_places(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = segments.Packer(bits)
        for batch in batches:
            key, mini, start = (c.to_numpy(zero_copy_only=False).astype(np.int64).view(ts.U) for c in batch.columns)
            yield from packer.add(_place(key, mini, start))
        yield from packer.flush()

    return run


def _edges(k: int, m: int, seed: int, known, heads, seg_bits: int):
    """Edges one by one, of pieces that may be first occurrences where paths branch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in ts.chunks(batch, "t"):
                words = ts.Words(raw, at)
                hashes, doc, start, size, low, _ = _known(words, k, m, seed, known.value, seg_bits)
                key = part.column(2).to_numpy(zero_copy_only=False)[doc]
                local = start - words.first[:-1][doc]
                keep = np.flatnonzero(segments.bloom_probe(heads.value, seg_bits, _place(key.view(ts.U), low, local), 3))
                doc, start, size, low, local = (x[keep] for x in (doc, start, size, low, local))
                each = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                grams = ts.gram_hashes(hashes, k)
                spread = lambda x: np.repeat(x, size)
                owner = pa.array(spread(doc))
                arrays = [pa.array(spread(low).view(np.int64)), pa.array(grams[spread(start) + each].view(np.int64))]
                arrays += [part.column(0).take(owner), part.column(1).take(owner), pa.array((spread(local) + each).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, ["mini", "edge", "id", "th", "at"])

    return run


def _list_slices(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row of each element, and the elements, of a list column (null: empty)."""
    size = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
    return np.repeat(np.arange(len(column)), size), column.flatten()


def _runs(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose lists have so many elements at most, or of one row."""
    for batch in batches:
        ends = np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _merge():
    """Overlapping windows of a text with one source and one distance to it become spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, 2):
            row, items = _list_slices(batch.column(2))
            if not len(row):
                continue
            at, width, source = (items.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 4))
            who, text = (items.field(i).dictionary_encode() for i in (2, 3))
            codes = [c.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in (who, text)]
            shift = at - source
            order = np.lexsort((at, shift, codes[1], codes[0], row))
            keys = np.stack([row, codes[0], codes[1], shift])[:, order]
            at, width = at[order], width[order]
            new = np.ones(len(row), bool)
            new[1:] = (keys[:, 1:] != keys[:, :-1]).any(0)
            reach = np.maximum.accumulate(at + width + (np.cumsum(new) << 40))  # the furthest end so far in each group
            new[1:] |= at[1:] + (np.cumsum(new)[1:] << 40) > reach[:-1]
            head = np.flatnonzero(new)
            last = np.append(head[1:], len(row)) - 1
            size = (reach[last] & ((1 << 40) - 1)) - at[head]
            pick = pa.array(order[head])
            owner = pa.array(keys[0][head])
            arrays = [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(at[head].astype(np.int32)), pa.array(size.astype(np.int32))]
            arrays += [items.field(2).take(pick), items.field(3).take(pick), items.field(4).take(pick)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "th", "at", "width", "sid", "sth", "sat"])

    return run


def _digests(words: ts.Words, row: np.ndarray, start: np.ndarray, width: np.ndarray) -> list[bytes]:
    """128 bits of the words of each span, which must lie in its text; else nothing."""
    buf, lo, hi = ts.single_spaced(words)
    view, first = memoryview(buf), words.first[:-1][row] + start
    inside = (start >= 0) & (start + width <= words.counts[row])
    ends = np.where(inside, first + width - 1, first)
    return [hashlib.blake2b(view[lo[a] : hi[b]], digest_size=16).digest() if ok else b"" for a, b, ok in zip(first.tolist(), ends.tolist(), inside.tolist())]


def _sources():
    """Digests of the spans asked of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in ts.chunks(batch, "t"):
                row, items = _list_slices(part.column(3))
                start, width = (items.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                owner, found = pa.array(row), _digests(ts.Words(raw, at), row, start, width)
                arrays = [part.column(0).take(owner), part.column(1).take(owner), items.field(0), items.field(1), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["sid", "sth", "sat", "width", "digest"])

    return run


def _kept(words: ts.Words, starts_row: np.ndarray, starts: np.ndarray, width: np.ndarray):
    """Mask of covered words for windows given by row, first word and width."""
    mark = np.zeros(len(words) + 1, np.int32)
    lo = words.first[starts_row] + starts
    np.add.at(mark, lo, 1)
    np.add.at(mark, lo + width, -1)
    return np.cumsum(mark[:-1]) > 0


def _rebuild(words: ts.Words, gone: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Removed words, removed spans and remaining text of each text."""
    n, doc = len(words.at) - 1, words.doc()
    stay = np.flatnonzero(~gone)
    left = ts.Words.__new__(ts.Words)
    left.raw, left.at, left.start, left.end = words.raw, words.at, words.start[stay], words.end[stay]
    buf, start, end = ts.single_spaced(left)
    first = np.searchsorted(doc[stay], np.arange(n + 1))
    size = np.where(np.diff(first) > 0, np.append(end, 0)[np.maximum(first[1:] - 1, 0)] - np.append(start, 0)[first[:-1]], 0)
    keep = np.ones(len(buf), bool)  # the space after a text's last word goes
    lasts = first[1:][np.diff(first) > 0] - 1
    keep[end[lasts]] = False
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(buf[keep].tobytes())).cast(pa.string())
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    new_doc = np.zeros(len(words) + 1, bool)
    new_doc[words.first] = True
    inner = np.flatnonzero(new_doc[1:-1] & gone[1:] & gone[:-1]) + 1 if len(gone) > 1 else np.zeros(0, np.int64)
    lo = np.sort(np.concatenate([np.flatnonzero(edge == 1), inner]))
    hi = np.sort(np.concatenate([np.flatnonzero(edge == -1), inner]))
    row = doc[lo] if len(lo) else np.zeros(0, np.int64)
    base = words.first[:-1][row]
    spans = pa.StructArray.from_arrays([pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32))], ["start", "end"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), spans)
    removed = np.bincount(doc[gone], minlength=n).astype(np.int64)
    return pa.array(removed), spans, text


def _finish():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in ts.chunks(batch, "t"):
                words = ts.Words(raw, at)
                row, items = _list_slices(part.column(2))
                start, width = (items.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                if _digests(words, row, start, width) != items.field(2).to_pylist():
                    raise Collision("a span differs from its source although their hashes agree; run again with another seed")
                removed, spans, text = _rebuild(words, _kept(words, row, start, width))
                counts = pa.array(words.counts.astype(np.int64))
                arrays = [part.column(0), counts, removed, spans, text, *part.columns[3:]]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n_words", "n_removed", "spans", "kept", *part.schema.names[3:]])

    return run


def remove_repeats(
    docs: DataFrame, k: int = 20, m: int = 6, filter_bytes: int = 16 << 20, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """``id, n_words, n_removed, spans, kept``: each text without windows that start earlier elsewhere.

    ``spans`` are the removed word ranges, ``kept`` the remaining words joined by
    single spaces.  ``filter_bytes`` is the fixed size of each broadcast filter.
    With ``carry``, a struct ``row`` holds these columns of the input.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    more = [F.struct(*(F.col(c) for c in carry)).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), *more)
    rows, text_bytes = common.told_apart(rows)
    seg_bits = segments.segment_bits(text_bytes)
    send = spark.sparkContext.broadcast
    known = send(segments.bloom_filter(rows.select("t").mapInArrow(common.lean(_packed(k, m, seed, seg_bits)), segments.SCHEMA), 2, filter_bytes, seg_bits))

    since = len(common.written(spark))
    occ = rows.select("id", "th", "t").mapInArrow(common.lean(_occurrences(k, m, seed, known, seg_bits)), f"mini bigint, whole bigint, id {kind}, th bigint, at int, n int, twice boolean")
    occ = common.materialise(occ, "pieces")
    path = occ.groupBy("mini", "whole").agg(F.min(F.struct("id", "th", "at")).alias("first"), F.count("*").alias("c"), F.max("twice").alias("inner"))
    path = common.materialise(path, "paths")
    branch = path.groupBy("mini").agg(F.count("*").alias("kinds"), F.max("inner").alias("inner")).filter("kinds > 1 or inner").select("mini")
    again = common.fresh_join(occ.select("mini", "whole", "id", "th", "at", "n"), path.filter("c > 1").select("mini", "whole", "first"), ["mini", "whole"])
    again = again.select("id", "th", "at", (F.col("n") + (k - 1)).alias("width"), "first")

    head = common.fresh_join(path.select("mini", "first"), branch, ["mini"]).select("mini", "first.id", "first.th", "first.at")
    head = head.select(F.xxhash64("id", "th").alias("key"), "mini", F.col("at").cast("bigint").alias("start"))
    heads = send(segments.bloom_filter(head.mapInArrow(common.lean(_pack_places(seg_bits)), segments.SCHEMA), 1, filter_bytes, seg_bits))
    keyed = rows.select("id", "th", F.xxhash64("id", "th").alias("key"), "t")
    edges = keyed.mapInArrow(common.lean(_edges(k, m, seed, known, heads, seg_bits)), f"mini bigint, edge bigint, id {kind}, th bigint, at int")
    edges = common.materialise(edges, "edges")
    first = edges.groupBy("mini", "edge").agg(F.min(F.struct("id", "th", "at")).alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
    later = common.fresh_join(edges, first, ["mini", "edge"]).select("id", "th", "at", F.lit(k).alias("width"), "first")
    gone = again.unionByName(later).filter(~F.struct("id", "th", "at").eqNullSafe(F.col("first")))

    window = F.struct("at", "width", F.col("first.id").alias("sid"), F.col("first.th").alias("sth"), F.col("first.at").alias("sat"))
    per_text = gone.select("id", "th", window.alias("w")).groupBy("id", "th").agg(F.collect_set("w").alias("windows"))
    span = per_text.mapInArrow(common.lean(_merge()), f"id {kind}, th bigint, at int, width int, sid {kind}, sth bigint, sat int")
    span = common.materialise(span, "spans")
    common.release(spark, [p for p in common.written(spark)[since:] if "/spans-" not in p])

    asked = span.groupBy("sid", "sth").agg(F.collect_set(F.struct("sat", "width")).alias("asked"))
    source = rows["id"].eqNullSafe(asked["sid"]) & (rows["th"] == asked["sth"])
    asked = rows.select("id", "th", "t").join(asked, source).select("id", "th", "t", "asked")
    proof = asked.mapInArrow(common.lean(_sources()), f"sid {kind}, sth bigint, sat int, width int, digest binary").distinct()
    proven = common.fresh_join(span, proof, ["sid", "sth", "sat", "width"]).select("id", "th", F.struct("at", "width", "digest").alias("w"))
    info = proven.groupBy("id", "th").agg(F.collect_set("w").alias("windows"))
    same = rows["id"].eqNullSafe(info["id"]) & (rows["th"] == info["th"])
    joined = rows.join(info, same, "left").select(rows["id"], rows["t"], info["windows"], *(["row"] if carry else []))
    schema = f"id {kind}, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept string"
    return joined.mapInArrow(common.lean(_finish()), schema + (f", row {rows.schema['row'].dataType.simpleString()}" if carry else ""))
