"""SimHash near-duplicates found through Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into segments of 22, 21 and 21 bits.  Two
fingerprints at most two bits apart agree in at least one segment (pigeonhole),
and in any other segment they differ by two bits at most.  Every 23-bit word lies
within three bits of exactly one codeword of the perfect binary Golay code, so
two words at most two bits apart have a codeword within four bits of both: the
midpoint's.  A word has one such codeword, or six if it is exactly three from its
own.  A key is therefore one exact segment and one codeword index of the next
segment: 3 to 18 keys for a fingerprint, and no link is missed.

Only distinct fingerprints are joined; equal ones are one class.  Buckets of at
most ``bucket`` fingerprints are paired and verified bit by bit.  The rest take
an exact way of linear size: two fingerprints are within two bits just if they
share a word within one bit of both, so each emits its 65 such words and joins
the smallest fingerprint of each word.

Defined cases: a null or empty text, or one without words, has fingerprint zero
and is linked like any other; fewer than three words are one shingle; repeated
rows each get a result row; a null ``doc_id`` is passed through and never is a
component's id unless all ids of the component are null; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from . import textscan as ts

SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Generator polynomial of the binary Golay code [23, 12, 7]: a fixed value.
GENERATOR = 0xC75


def _remainders() -> np.ndarray:
    """Remainder of each 23-bit word by the generator, built bit by bit."""
    unit = []
    for k in range(23):
        r = 1 << k
        for j in range(k, 10, -1):
            if r >> j & 1:
                r ^= GENERATOR << (j - 11)
        unit.append(r)
    return np.array(unit, np.int64)


def _leaders(unit: np.ndarray) -> np.ndarray:
    """For each remainder the one error pattern of at most three bits that leaves it."""
    table = np.zeros(1 << 11, np.int64)
    for a in range(23):
        table[unit[a]] = 1 << a
        for b in range(a):
            table[unit[a] ^ unit[b]] = 1 << a | 1 << b
            for c in range(b):
                table[unit[a] ^ unit[b] ^ unit[c]] = 1 << a | 1 << b | 1 << c
    return table


class Golay:
    """Codeword indices near 23-bit words."""

    def __init__(self):
        self.unit = _remainders()
        self.leader = _leaders(self.unit)
        low = np.arange(1 << 12, dtype=np.int64) << 11
        words = low ^ self._remainder(low)
        self.sevens = words[self._weight(words) == 7]

    def _remainder(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.int64)
        for k in range(23):
            out ^= np.where(x >> k & 1, self.unit[k], 0)
        return out

    @staticmethod
    def _weight(x: np.ndarray) -> np.ndarray:
        return sum((x >> k & 1) for k in range(23))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codeword within three bits, and the error pattern."""
        error = self.leader[self._remainder(x)]
        return x ^ error, error

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and 12-bit indices of all codewords within four bits of each word."""
        code, error = self.nearest(x)
        rows, found = [np.arange(len(x))], [code >> 11]
        far = np.flatnonzero(self._weight(error) == 3)
        patterns, back = np.unique(error[far], return_inverse=True)
        cover = [self.sevens[(self.sevens & p) == p] for p in patterns]  # five codewords of weight 7 hold any three bits
        if len(far):
            other = np.array(cover)[back] ^ code[far][:, None]
            rows.append(np.repeat(far, other.shape[1]))
            found.append((other >> 11).ravel())
        return np.concatenate(rows), np.concatenate(found)


def shingle_hashes(words: ts.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of ``k`` lower-cased words, text by text, and how many each text has."""
    n = words.counts
    buf, start, end = ts.single_spaced(words, lower=True)
    grams = np.maximum(n - k + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), grams)
    if not len(doc):
        return np.zeros(0, ts.U), grams
    first = words.first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(grams) - grams, grams)
    last = np.minimum(first + k, words.first[1:][doc]) - 1
    return ts.xxh64(buf, start[first], end[last] - start[first]), grams


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each of consecutive runs of hashes, the word of the bits that more than half of them have.

    Eight passes, each summing eight bits in lanes of eight; pieces stay below 256 hashes.
    """
    out, step = np.zeros(len(counts), ts.U), 255
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    pieces = -(-counts[full] // step)
    owner = np.repeat(full, pieces)
    cuts = np.repeat((np.cumsum(counts) - counts)[full], pieces) + step * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    lane = ts.U(0x0101010101010101)
    for b in range(8):
        sums = np.add.reduceat((hashes >> ts.U(b)) & lane, cuts)
        for j in range(8):
            total = np.bincount(owner, (sums >> ts.U(8 * j) & ts.U(0xFF)).astype(float), len(counts))
            out |= (total > counts / 2).astype(ts.U) << ts.U(b + 8 * j)
    return out


def _fingerprints(raw: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    return majority(*shingle_hashes(ts.Words(raw, at), k))


def fingerprint(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp`` (a signed 64-bit number) of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in ts.chunks(batch, "t"):
                fp = _fingerprints(raw, at, k).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def golay_keys(fps: DataFrame) -> DataFrame:
    """``fp, key`` for distinct fingerprints ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(ts.U)
            parts = [(fp >> ts.U(s) & ts.U((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
            for j in range(3):
                rows, index = golay.keys(parts[(j + 1) % 3])
                key = (j << 40) | (parts[j][rows] << 12) | index
                yield pa.RecordBatch.from_arrays([pa.array(fp[rows].view(np.int64)), pa.array(key)], ["fp", "key"])

    return fps.select("fp").mapInArrow(run, "fp bigint, key bigint")


def _flips(fp: Column) -> Column:
    """The word itself and the 64 words one bit away."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    return F.concat(F.array(fp), bits)


def links(fps: DataFrame, distance: int = 2, bucket: int = 64) -> DataFrame:
    """``a, b``: verified pairs whose components are those of all pairs within two bits."""
    if distance != 2:
        raise ValueError("the key geometry is for a distance of two bits")
    keyed = common.materialise(golay_keys(fps), "golay")
    count = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = common.materialise(common.fresh_join(keyed, count, ["key"]), "buckets")
    lists = keyed.filter(F.col("n") <= bucket).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pairs = lists.select(F.posexplode("fps").alias("i", "a"), "fps").select("a", F.explode(F.slice("fps", F.col("i") + 2, bucket)).alias("b"))
    pairs = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    rest = keyed.filter(F.col("n") > bucket).select("fp").distinct().select("fp", F.explode(_flips(F.col("fp"))).alias("word"))
    hub = rest.groupBy("word").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).filter("a <> last").select("word", "a")
    star = common.fresh_join(rest, hub, ["word"]).filter("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(star).distinct()


def near_duplicates(docs: DataFrame, k: int = 3, distance: int = 2, bucket: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp, component``: the smallest id reachable over links of at most ``distance`` bits."""
    marked = common.materialise(fingerprint(docs, k, id_col, text_col), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("id").alias("low"))
    classes = common.materialise(classes, "classes")
    since = len(common.written(docs.sparkSession))
    found = common.components(links(classes, distance, bucket))
    common.keep_last(docs.sparkSession, since)
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = common.fresh_join(rooted.select("fp", "root"), best, ["root"]).select("fp", "component")
    return common.fresh_join(marked, named, ["fp"]).select("id", "fp", "component")
