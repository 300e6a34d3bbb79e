"""Counting 64-bit hashes in bulk: packed runs, dealt by the hash's leading bits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from . import textscan as ts

SCHEMA = "seg int, hashes binary, counts binary"
LARGE = 4 << 20  # bytes of a segment after which a worker hands back what it has freed


class Packer:
    """Gathers hashes of a task; every ``most`` of them it emits one packed run for each segment."""

    def __init__(self, bits: int, most: int = 2 << 20):
        self.bits, self.most, self.held, self.size = bits, most, [], 0

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(hashes)
        self.size += len(hashes)
        if self.size >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        values, counts = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.size = [], 0
        seg = values >> ts.U(64 - self.bits)
        cut = np.flatnonzero(np.diff(seg, prepend=seg[:1] + ts.U(1)))
        hi = [*cut[1:], len(values)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(seg[cut].astype(np.int32)),
                pa.array([values[a:b].tobytes() for a, b in zip(cut, hi)], pa.binary()),
                pa.array([np.minimum(counts[a:b], 0xFFFFFFFF).astype(np.uint32).tobytes() for a, b in zip(cut, hi)], pa.binary()),
            ],
            ["seg", "hashes", "counts"],
        )


def merge(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of one segment, ascending, and their counts."""
    values = np.concatenate([np.frombuffer(x.as_buffer(), ts.U) for x in table.column("hashes")])
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("counts")])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.add.reduceat(counts.astype(np.int64), first)


def by_segment(packed: DataFrame, run: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Apply ``run`` to all packed runs of each segment.

    Segments are hash ranges of like size; a frequent hash comes once from each
    run of the packer, so no segment outgrows the others.
    """

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        out = run(key[0].as_py(), table)
        if table.nbytes >= LARGE:
            del table
            common.give_back()
        return out

    return packed.groupBy("seg").applyInArrow(whole, schema)


def dealt(packed: DataFrame, parts: int) -> DataFrame:
    """Packed runs dealt by segment, for several passes: the shuffle is made now, and its files serve them all."""
    spark, held = packed.sparkSession, packed.repartitionById(parts, "seg")
    return DataFrame(spark._jsparkSession.createDataFrame(held._jdf.rdd(), held._jdf.schema()), spark)


def by_dealt(held: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Apply ``run`` to all packed runs of each of the parts that :func:`dealt` has made, whole segments together."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := [x for x in batches if x.num_rows]:
            yield from run(pa.Table.from_batches(found)).to_batches()

    return held.mapInArrow(common.lean(whole), schema)


def segment_bits(rows_bytes: int, each: int = 32 << 20) -> int:
    """Segments for so many bytes of text: about one for each ``each`` bytes, at least 64."""
    return max(6, int(np.ceil(np.log2(max(1, rows_bytes / each)))))


def filter_parts(filter_bytes: int, seg_bits: int) -> int:
    """Leading bits of a hash that choose its part of a filter; a part has 64 words at least."""
    return min(seg_bits, (filter_bytes // 512).bit_length() - 1)


def bloom_filter(packed: DataFrame, least: int, filter_bytes: int, seg_bits: int) -> np.ndarray:
    """Words of a Bloom filter of the packed hashes met at least so often; its size, a power of two, is fixed beforehand.

    The filter's parts are chosen by :func:`filter_parts` bits; where segments are finer than
    parts, those of a part are joined in a second step.
    """
    if filter_bytes & (filter_bytes - 1) or filter_bytes < 512:
        raise ValueError("a filter has a power of two of bytes, 512 at least")
    bits = filter_parts(filter_bytes, seg_bits)
    part = filter_bytes // 8 >> bits
    schema = "seg int, bits binary"

    def build(seg: int, table: pa.Table) -> pa.Table:
        values, counts = merge(table)
        own, made = seg >> (seg_bits - bits), np.zeros(part, ts.U)
        for at in bloom_places(filter_bytes * 8, bits, values[counts >= least], 3):
            at = at - own * part * 64
            np.bitwise_or.at(made, at >> 6, ts.U(1) << (at & 63).astype(ts.U))
        return pa.table({"seg": pa.array([own], pa.int32()), "bits": pa.array([made.tobytes()], pa.binary())})

    def join(seg: int, table: pa.Table) -> pa.Table:
        made = np.zeros(part, ts.U)
        for x in table.column("bits"):
            made |= np.frombuffer(x.as_buffer(), ts.U)
        return pa.table({"seg": pa.array([seg], pa.int32()), "bits": pa.array([made.tobytes()], pa.binary())})

    parts = by_segment(packed, build, schema)
    if seg_bits > bits:
        parts = by_segment(parts, join, schema)
    out = np.zeros(filter_bytes // 8, ts.U)
    for row in parts.toLocalIterator():
        out[row.seg * part : (row.seg + 1) * part] = np.frombuffer(row.bits, ts.U)
    return out


def bloom_probe(bits: np.ndarray, seg_bits: int, hashes: np.ndarray, k: int = 3) -> np.ndarray:
    """Whether each hash may be in a filter that :func:`bloom_filter` made of segments of so many bits."""
    live = np.arange(len(hashes))
    n_bits, parts = len(bits) * 64, filter_parts(len(bits) * 8, seg_bits)
    for i in range(k):
        at = next(bloom_places(n_bits, parts, hashes[live], 1, i))
        live = live[(bits[at >> 6] >> (at & 63).astype(ts.U) & ts.U(1)).astype(bool)]
    out = np.zeros(len(hashes), bool)
    out[live] = True
    return out


def bloom_places(n_bits: int, parts: int, hashes: np.ndarray, k: int, first: int = 0) -> Iterator[np.ndarray]:
    """Bit positions of each hash; all lie in its own part of the filter."""
    part = n_bits >> parts  # a power of two
    base = (hashes >> ts.U(64 - parts)).astype(np.int64) * part
    step = ts.mix(hashes) | ts.U(1)
    for i in range(first, first + k):
        yield base + ((hashes + ts.U(i + 1) * step) & ts.U(part - 1)).astype(np.int64)


def filter_bytes(items: int, most: int, seg_bits: int) -> int:
    """Bytes of a filter with 16 bits an item, a power of two, at most ``most``."""
    return min(most, 1 << max(3 + seg_bits, 16, int(2 * items).bit_length()))


def pack_longs(bits: int):
    """Packed runs of a column of 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(bits)
        for batch in batches:
            yield from packer.add(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(ts.U))
        yield from packer.flush()

    return run


def may_be_among(rows: DataFrame, hash_of: Column, keys: DataFrame, most: int = 16 << 20) -> Column:
    """A column that is true for rows whose hash is among ``keys`` (one bigint column), and for few others.

    A broadcast Bloom filter of at most ``most`` bytes, whatever the number of keys; only
    the hash passes through Python.
    """
    n = keys.count()
    if not n:
        return F.lit(False)
    size = filter_bytes(n, most, 6)
    mixed = keys.select(F.xxhash64(keys.columns[0]))
    sent = rows.sparkSession.sparkContext.broadcast(bloom_filter(mixed.mapInArrow(pack_longs(6), SCHEMA), 1, size, 6))

    @F.arrow_udf("boolean")
    def probe(h: pa.Array) -> pa.Array:
        return pa.array(bloom_probe(sent.value, 6, h.to_numpy(zero_copy_only=False).astype(np.int64).view(ts.U)))

    return probe(F.xxhash64(hash_of))
