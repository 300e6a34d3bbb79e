"""SimHash near copies at a stated similarity: Golay keys of wide fingerprints, verified exactly.

The 64-bit fingerprints of :mod:`simhash` tell texts apart that differ in a few bits, which
takes a similarity near one.  Here a text has a fingerprint of 24 segments of 23 bits, each
the majority of its shingles' hashes.  Every segment is decoded to the index of the codeword
next to it in the perfect Golay code; a key is the indices of two segments.  Texts whose
errors leave two segments alike (pigeonhole over segments) share one of the 276 keys, become
candidates, and are linked if the Jaccard similarity of their sets of ``k``-word shingles is at
least ``least``, which is computed exactly.

Fingerprints are made of shingles of ``by`` words: an edited word changes two shingles of two
words but five of five, so copies with scattered edits keep most of their bits.  The link
itself is always that of the ``k``-word sets.  Recall as simulated (400 pairs a cell, texts of
300 and 1000 words): scattered edits 0.992 or more at 0.8 and 0.998 or more from 0.85 on; one
inserted block 0.81 at 0.8, 0.92 at 0.85, 0.99 at 0.9, 0.998 at 0.95.

Keys are packed and dealt by their hash.  Each entry carries 24 more bits of fingerprint and
the size of the set, so texts that merely share a key are told apart.  A text is asked about if
it meets another one in a bucket; in a bucket of more than ``bucket`` texts all are.

Among the texts asked about every pair at ``least`` is found, by prefixes: the shingles of a text in
a fixed order, rare ones first, as a table of counts has them; two similar texts share one of
the first ``|x| - least * |x| + 1`` shingles of both, at places that leave room for the rest.
Texts that share such a shingle are paired and verified.  In a large group, where more than ``bucket``
texts share one, each first meets the text in which the fewest rarer shingles precede it, which
is the least edited one; then all texts that this leaves in different components are paired, so
no link is lost and a group costs linear work as a rule.  The table of counts only decides how
much work there is: any order finds the same pairs.

Defined cases: words are lower-cased; fewer than ``k`` words are one shingle; null texts,
empty texts and texts without words have the empty set and are copies of each other; texts
with equal sets are one class, and shingles and sets are equal if their 64-bit hashes are;
ids may be null or repeat, as rows are told apart by ``row_col``; a long text is one run of
words; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, segments, simhash
from . import textscan as ts

SEGMENTS, WIDTH = 24, 23
_WORDS = 9  # of 64 bits; what the segments leave over are the check bits
_CHECK_BITS = 64 * _WORDS - SEGMENTS * WIDTH
_FAR, _SIZES = 9, 6  # check bits and steps of size that two texts may differ by


def _sets(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending in each text, and each text's count."""
    hashes, counts = simhash.shingle_hashes(ts.Words(raw, at), k)
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.bincount(doc[new], minlength=len(counts))


def _classes(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each text's set; zero for the empty set."""
    out, full = np.zeros(len(size), ts.U), np.flatnonzero(size)
    if len(full):
        out[full] = np.add.reduceat(ts.mix(hashes), (np.cumsum(size) - size)[full])
    return out.view(np.int64)


def fingerprints(raw: np.ndarray, at: np.ndarray, by: int) -> np.ndarray:
    """Nine words of 64 bits for each text."""
    hashes, counts = _sets(raw, at, by)
    salts = ts.mix(np.arange(_WORDS, dtype=ts.U))
    return np.stack([simhash.majority(ts.mix(hashes ^ s), counts) for s in salts], 1) if len(counts) else np.zeros((0, _WORDS), ts.U)


def indices(prints: np.ndarray, golay: simhash.Golay) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of all segments, and the check bits, of each fingerprint."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    words = bits[:, : SEGMENTS * WIDTH].reshape(len(prints), SEGMENTS, WIDTH).astype(np.int64) @ (1 << np.arange(WIDTH))
    rest = bits[:, SEGMENTS * WIDTH :].astype(np.int64) @ (1 << np.arange(_CHECK_BITS))
    return golay.nearest(words)[0] >> 11, rest


def _sketches(k: int, by: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in ts.chunks(batch, "t"):
                hashes, size = _sets(raw, at, k)
                prints = fingerprints(raw, at, by)
                packed = pa.array([p.tobytes() for p in prints], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_classes(hashes, size)), pa.array(size.astype(np.int64)), packed], ["tag", "class", "size", "print"])

    return run


_PACKED = "seg int, keys binary, classes binary, checks binary, marks binary"


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: each entry's place in its bucket, and the bucket's size."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(keys)))
    return np.arange(len(keys)) - np.repeat(head, size), np.repeat(size, size)


def _dealt(seg: np.ndarray, columns: list[np.ndarray]) -> tuple[pa.Array, list[pa.Array]]:
    """Sorted segments, and each column as one packed run for each of them."""
    cut = np.flatnonzero(np.diff(seg, prepend=-1))
    hi = [*cut[1:], len(seg)]
    return pa.array(seg[cut].astype(np.int32)), [pa.array([x[lo:up].tobytes() for lo, up in zip(cut, hi)], pa.binary()) for x in columns]


def _keyed(bits: int, bucket: int, most: int = 1024):
    """Packed keys of classes; of a bucket that is large within a run so many go on that it stays large, and the others are met."""
    i, j = np.triu_indices(SEGMENTS, 1)
    pair_no = (np.arange(len(i), dtype=np.int64) << 24)[None, :]

    def flush(golay, prints: list, classes: list, sizes: list) -> Iterator[pa.RecordBatch]:
        code, rest = indices(np.concatenate(prints), golay)
        one, size = (np.concatenate(classes).view(ts.U) >> ts.U(32)).astype(np.uint32), np.concatenate(sizes)
        step = np.minimum(np.rint(np.log(np.maximum(size, 1)) / np.log(1.05)), 255).astype(np.int64)
        check = (rest << 8 | step).astype(np.uint32)
        key = ts.mix((pair_no | code[:, i] << 12 | code[:, j]).ravel().view(ts.U))
        order = np.argsort(key, kind="stable")
        key, who = key[order], order // len(i)
        kept = _places(key)[0] <= bucket
        marks = np.unique(one[who[~kept]])
        key, who = key[kept], who[kept]
        seg, packs = _dealt((key >> ts.U(64 - bits)).astype(np.int64), [(key >> ts.U(32 - bits)).astype(np.uint32), one[who], check[who]])
        yield pa.RecordBatch.from_arrays([seg, *packs, pa.array([marks.tobytes(), *[b""] * (len(seg) - 1)], pa.binary())], ["seg", "keys", "classes", "checks", "marks"])  # they only travel with a segment

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay, held, n = simhash.Golay(), ([], [], []), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                part = batch.slice(lo, most)
                held[0].append(np.frombuffer(b"".join(part.column(2).to_pylist()), ts.U).reshape(-1, _WORDS))
                held[1].append(part.column(0).to_numpy())
                held[2].append(part.column(1).to_numpy())
                n += part.num_rows
                if n >= most:
                    yield from flush(golay, *held)
                    held, n = ([], [], []), 0
        if n:
            yield from flush(golay, *held)

    return run


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _met(bucket: int, bits: int):
    """The classes (their upper halves) that meet another one in a bucket of this segment, dealt anew."""

    def run(seg: int, table: pa.Table) -> pa.Table:
        keys, classes, checks = (_joined(table, c, np.uint32) for c in ("keys", "classes", "checks"))
        order = np.argsort(keys, kind="stable")
        keys, classes, checks = keys[order], classes[order], checks[order]
        place, size = _places(keys)
        met = size > bucket
        rows = np.flatnonzero(~met & (place > 0))
        for d in range(1, bucket):
            rows = rows[place[rows] >= d]
            if not len(rows):
                break
            x, y = checks[rows], checks[rows - d]
            near = np.bitwise_count((x ^ y) >> np.uint32(8)) <= _FAR
            near &= np.abs((x & np.uint32(0xFF)).astype(np.int16) - (y & np.uint32(0xFF)).astype(np.int16)) <= _SIZES
            met[rows[near]] = met[rows[near] - d] = True
        found = np.unique(np.concatenate([classes[met], _joined(table, "marks", np.uint32)]))
        seg, packs = _dealt((found >> np.uint32(32 - bits)).astype(np.int64), [found])
        return pa.table([seg, *packs], ["seg", "classes"])

    return run


def asked_about(classes: DataFrame, bucket: int, n: int) -> DataFrame:
    """``half``: the upper 32 bits of the classes, of ``n`` rows ``class, size, print``, that share a key with another one and pass the check bits."""
    made = classes.select("class", "size", "print").mapInArrow(common.lean(_keyed(segments.segment_bits(n * 12 * SEGMENTS * (SEGMENTS - 1) // 2), bucket)), _PACKED)
    met = segments.by_segment(made, _met(bucket, segments.segment_bits(n * 4)), "seg int, classes binary")
    return segments.by_segment(met, lambda seg, table: pa.table({"half": pa.array(np.unique(_joined(table, "classes", np.uint32)).astype(np.int64))}), "half bigint")


def _gram_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, at in ts.chunks(batch, "t"):
                hashes, size = _sets(raw, at, k)
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(_classes(hashes, size)), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))], ["class", "grams"])

    return run


_PARTS, _SLOTS = 10, 22  # bits of the number of parts and of slots of the table of counts


def _slots(grams: np.ndarray, bits: int) -> np.ndarray:
    return (ts.mix(grams) >> ts.U(64 - bits)).astype(np.int64)


def counted(sets: DataFrame, n_grams: int) -> np.ndarray:
    """A table of counts of shingles: a shingle's slot holds the sum over all shingles of the slot, 65,535 at most."""
    bits = max(_PARTS, min(_SLOTS, n_grams.bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            grams = batch.column(0).flatten().to_numpy().view(ts.U)
            for lo in range(0, len(grams), 1 << 20):
                slot, n = np.unique(_slots(grams[lo : lo + (1 << 20)], bits), return_counts=True)
                held[slot] = np.minimum(held[slot] + n, 0xFFFF)
        parts = held.reshape(1 << _PARTS, -1)
        full = np.flatnonzero(parts.any(1))
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([parts[k].tobytes() for k in full], pa.binary())], ["seg", "counts"])

    def add(seg: int, table: pa.Table) -> pa.Table:
        total = np.zeros(1 << bits - _PARTS, np.uint32)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.uint16)
        return pa.table({"seg": pa.array([seg], pa.int32()), "counts": pa.array([np.minimum(total, 0xFFFF).astype(np.uint16).tobytes()], pa.binary())})

    out = np.zeros((1 << _PARTS, 1 << bits - _PARTS), np.uint16)
    for row in segments.by_segment(sets.select("grams").mapInArrow(common.lean(run), "seg int, counts binary"), add, "seg int, counts binary").toLocalIterator():
        out[row.seg] = np.frombuffer(row.counts, np.uint16)
    return out.ravel()


_POSTING = np.dtype([("key", "<u8"), ("class", "<i8"), ("root", "<i8"), ("size", "<u4"), ("pos", "<u4")])
_FIRST = _POSTING.descr[:2] + _POSTING.descr[3:]
_EPS = 1e-9


def _postings(counts, bits: int, least: float, over: int, kind: np.dtype, most: int = 1 << 19):
    """The prefixes of rows ``class, root, grams``, dealt by shingle; shingles counted ``over`` times or less are left out."""

    def flush(classes: list, roots: list, grams: list) -> Iterator[pa.RecordBatch]:
        size = np.array([len(g) for g in grams])
        gram, doc = np.concatenate(grams).view(ts.U), np.repeat(np.arange(len(size)), size)
        often = counts.value[_slots(gram, len(counts.value).bit_length() - 1)]
        order = np.lexsort((gram, often, doc))  # by text, rare shingles first
        pos = np.arange(len(gram)) - np.repeat(np.cumsum(size) - size, size)
        prefix = size - np.ceil(least * size - _EPS).astype(np.int64) + 1
        kept = (pos < prefix[doc]) & (often[order] > over)
        gram, doc, pos = gram[order][kept], doc[kept], pos[kept]
        order = np.argsort(gram >> ts.U(64 - bits), kind="stable")
        gram, doc, pos = gram[order], doc[order], pos[order]
        rows = np.zeros(len(gram), kind)
        rows["key"], rows["class"], rows["size"], rows["pos"] = gram, np.array(classes)[doc], size[doc], pos
        if "root" in kind.names:
            rows["root"] = np.array(roots)[doc]
        if len(rows):
            seg, packs = _dealt((gram >> ts.U(64 - bits)).astype(np.int64), [rows])
            yield pa.RecordBatch.from_arrays([seg, *packs], ["seg", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = ([], [], []), 0
        for batch in batches:
            ends, grams = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            for k, (klass, root) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                held[0].append(klass)
                held[1].append(root)
                held[2].append(grams[ends[k] : ends[k + 1]])
                n += int(ends[k + 1] - ends[k])
                if n >= most:
                    yield from flush(*held)
                    held, n = ([], [], []), 0
        if held[0]:
            yield from flush(*held)

    return run


def _room(e: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether entries that share a shingle, and none before it, may be alike by their sizes and places."""
    x, y = e[a], e[b]
    n, m = x["size"].astype(np.int64), y["size"].astype(np.int64)
    need = np.ceil(least / (1 + least) * (n + m) - _EPS)
    return (x["class"] != y["class"]) & (np.minimum(n, m) >= least * np.maximum(n, m) - _EPS) & (np.minimum(n - x["pos"], m - y["pos"]) >= need)


def _pairs(e: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (e["class"][np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)])] for k in (0, 1))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _first(bucket: int, least: float):
    """Pairs of the small buckets, and each text of a large one with the least edited; a row of nulls tells that there are large ones."""

    def run(seg: int, table: pa.Table) -> pa.Table:
        e = _joined(table, "postings", _FIRST)
        e = e[np.lexsort((e["class"], e["pos"], e["key"]))]
        place, size = _places(e["key"])
        large, found = np.flatnonzero((size > bucket) & (place > 0)), []
        rows = np.flatnonzero((size <= bucket) & (place > 0))
        for d in range(1, bucket):
            rows = rows[place[rows] >= d]
            if not len(rows):
                break
            ok = _room(e, rows - d, rows, least)
            found.append((rows[ok] - d, rows[ok]))
        ok = _room(e, large - place[large], large, least)
        found.append(((large - place[large])[ok], large[ok]))
        more = [None] if len(large) else []
        a, b = _pairs(e, found)
        return pa.table({"a": pa.array([*a.tolist(), *more], pa.int64()), "b": pa.array([*b.tolist(), *more], pa.int64())})

    return run


def _second(bucket: int, least: float, most: int = 1 << 19):
    """All pairs of the large buckets that are in different components."""

    def run(seg: int, table: pa.Table) -> pa.Table:
        e = _joined(table, "postings", _POSTING)
        e = e[np.lexsort((e["root"], e["key"]))]
        place, size = _places(e["key"])
        found = []
        for lo in np.flatnonzero((place == 0) & (size > bucket)).tolist():
            hi = lo + int(size[lo])
            names, n = np.unique(e["root"][lo:hi], return_counts=True)
            if len(names) == 1:
                continue
            few = lo + np.flatnonzero(e["root"][lo:hi] != names[n.argmax()])  # every pair has one outside the largest component
            step = max(1, most // (hi - lo))
            for at in range(0, len(few), step):
                part = few[at : at + step]
                a, b = np.nonzero(e["root"][part][:, None] != e["root"][lo:hi][None])
                a, b = part[a], b + lo
                ok = _room(e, a, b, least)
                found.append((a[ok], b[ok]))
            if sum(len(f[0]) for f in found) > 4 * most:
                a, b = _pairs(e, found)
                first = np.unique(e["class"], return_index=True)
                at = [first[1][np.searchsorted(first[0], v)] for v in (a, b)]
                found = [(at[0], at[1])]
        a, b = _pairs(e, found)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``a, b`` of at least this similarity."""
    one = common.fresh_join(pairs, sets.select(F.col("class").alias("a"), F.col("grams").alias("ga")), ["a"])
    two = common.fresh_join(one, sets.select(F.col("class").alias("b"), F.col("grams").alias("gb")), ["b"])
    both = two.select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("n"), (F.size("ga") + F.size("gb")).alias("m"))
    return both.filter(F.col("n") / (F.col("m") - F.col("n")) >= least).select("a", "b")


def near_copies(docs: DataFrame, k: int = 5, least: float = 0.8, by: int = 2, bucket: int = 32, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``id, row, component`` of each row; ``row`` is the column ``row_col`` (or null), ``component`` a class."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.col(row_col) if row_col else F.lit(None).cast("bigint")
    rows = docs.select(F.struct(F.col(id_col).alias("id"), row.alias("row"), F.xxhash64(text).alias("text")).alias("tag"), text.alias("t"))
    schema = f"tag {rows.schema['tag'].dataType.simpleString()}, class bigint, size bigint, print binary"
    known = common.materialise(rows.mapInArrow(common.lean(_sketches(k, by)), schema), "sketches")
    # texts of a class are alike but for the order of repeats: one of them stands for all
    classes = known.filter("size > 0").groupBy("class").agg(F.max("size").alias("size"), F.min("tag.text").alias("text"), F.min("print").alias("print"))
    since = len(common.written(docs.sparkSession))
    classes = common.materialise(classes, "classes")
    n = classes.count()
    asked = common.materialise(asked_about(classes, bucket, n), "met")
    halves = classes.select(F.shiftrightunsigned("class", 32).alias("half"), "text")
    asked = common.materialise(common.fresh_join(halves, asked, ["half"]).select("text"), "asked")
    plain = rows.select(F.col("tag.text").alias("text"), "t")
    maybe = plain.filter(segments.may_be_among(plain, F.col("text"), asked))
    texts = maybe.groupBy("text").agg(F.any_value("t").alias("t"))  # copies of a text meet map-side first
    sets = common.materialise(texts.join(asked, "text", "left_semi").select("t").mapInArrow(common.lean(_gram_sets(k)), "class bigint, grams array<bigint>"), "sets")

    n_grams = sets.agg(F.sum(F.size("grams"))).first()[0] or 0
    counts = docs.sparkSession.sparkContext.broadcast(counted(sets, n_grams))
    bits = segments.segment_bits(n_grams * _POSTING.itemsize // 4)
    plain = sets.select("class", F.col("class").alias("root"), "grams")
    made = plain.mapInArrow(common.lean(_postings(counts, bits, least, 1, np.dtype(_FIRST))), "seg int, postings binary")
    pairs = common.materialise(segments.by_segment(made, _first(bucket, least), "a bigint, b bigint").distinct(), "pairs")
    links = common.materialise(_verified(pairs.filter("a is not null"), sets, least), "first")
    root = common.components(links)
    if pairs.filter("a is null").head(1):
        tied = sets.join(root.withColumnRenamed("node", "class"), "class", "left").select("class", F.coalesce("root", "class").alias("root"), "grams")
        made = tied.mapInArrow(common.lean(_postings(counts, bits, least, min(bucket, 0xFFFE), _POSTING)), "seg int, postings binary")
        rest = common.materialise(segments.by_segment(made, _second(bucket, least), "a bigint, b bigint").distinct(), "rest")
        more = common.materialise(_verified(rest, sets, least), "others")
        if more.head(1):
            root = common.components(links.unionByName(more))
            common.keep_last(docs.sparkSession, since)
    named = known.select("tag.id", "tag.row", "class").join(root.withColumnRenamed("node", "class"), "class", "left")
    return named.select("id", "row", F.coalesce("root", "class").alias("component"))
