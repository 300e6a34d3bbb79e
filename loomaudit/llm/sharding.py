"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations.

The ring has ``2 ** ring_bits`` cells.  Each shard owns ``nodes`` virtual nodes,
each in a cell of its own; a row's cell is the low bits of ``xxhash64`` of its id.
A row goes to the first virtual node clockwise from its cell whose shard has room;
the room of a shard is ``(1 + slack)`` times the mean count, at least enough for
all rows, with whole rows dealt so that no two shards differ by more than one.

Rows of a cell are alike to the ring, so only counts matter: one aggregate counts
the rows of each cell (partial sums; at most ``2 ** ring_bits`` numbers, a fixed
bound), the driver walks the ring over these counts, and the resulting intervals
(cell, ranks from and to, shard, first slot) are broadcast, again within a fixed
bound.  Each row finds its interval by its rank in its cell.  Texts are never
shuffled: only the id, size, checksum and cell are.  A cell with more than one in
``PARTS`` of all rows (an id that repeats) is ranked in as many parts, dealt by the place
of a row in its table, and the parts' sizes are added up.

Defined cases: a null text has size 1 and the checksum of no bytes; a null id is
placed by a hash of the text; rows that agree in all these columns are
interchangeable and fill different slots; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


PARTS = 64


def _mix(x: int) -> int:
    """The splitmix64 finaliser."""
    x = (x + 0x9E3779B97F4A7C15) & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ x >> 31


def ring(shards: int, nodes: int, ring_bits: int) -> dict[int, int]:
    """Cells of all virtual nodes and their shards; a taken cell moves on to the next.

    A shard's nodes depend on its number alone, save for such moves, so one more
    shard leaves the nodes of the others where they are.
    """
    cells = 1 << ring_bits
    if shards * nodes > cells // 4:
        raise ValueError("too many virtual nodes for the ring; raise ring_bits")
    out: dict[int, int] = {}
    for shard in range(shards):
        for node in range(nodes):
            cell = _mix(shard << 32 | node) % cells
            while cell in out:
                cell = (cell + 1) % cells
            out[cell] = shard
    return out


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard; without slack they sum to ``total`` and differ by one at most."""
    most = int(total * (1 + slack))
    return [most // shards + (s < most % shards) for s in range(shards)]


def walk(counts: dict[int, int], shards: int, nodes: int, ring_bits: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """Intervals ``cell, from, to, shard, slot`` that place all rows of all cells.

    Rounds by distance: in each, what is left of every cell is offered to the next
    virtual node clockwise, nearest cells first; a full shard passes it on.
    """
    cells = 1 << ring_bits
    owner = ring(shards, nodes, ring_bits)
    stops = sorted(owner)
    room = capacities(sum(counts.values()), shards, slack)
    slot = [0] * shards
    out = []
    here = {}  # index of the next stop -> [cell, next rank, rows left]
    k = 0
    for cell in sorted(counts):
        while k < len(stops) and stops[k] < cell:
            k += 1
        here.setdefault(k % len(stops), []).append([cell, 0, counts[cell]])
    while here:
        onward: dict[int, list] = {}
        for k in sorted(here):
            shard = owner[stops[k]]
            # cells that reach this stop, nearest first
            for cell, rank, left in sorted(here[k], key=lambda x: (stops[k] - x[0]) % cells):
                take = min(left, room[shard])
                if take:
                    out.append((cell, rank, rank + take, shard, slot[shard]))
                    room[shard] -= take
                    slot[shard] += take
                if left > take:
                    onward.setdefault((k + 1) % len(stops), []).append([cell, rank + take, left - take])
        here = onward
    return out


def shard_rows(
    docs: DataFrame, shards: int = 16, nodes: int = 64, ring_bits: int = 14, slack: float = 0.05, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, size, text_crc32, shard, slot``; slots of a shard are gapless from 0.

    ``size`` is the text's UTF-8 bytes plus one, ``text_crc32`` its unsigned checksum.
    """
    if shards < 1 or slack < 0:
        raise ValueError("shards must be positive and slack must not be negative")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    place = F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.xxhash64(text)))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        place.bitwiseAND((1 << ring_bits) - 1).cast("int").alias("cell"),
        place.alias("place"),
    )
    rows = common.materialise(rows, "ring")  # so that a row has the same part of its cell whenever it is read
    counts = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(walk(counts, shards, nodes, ring_bits, slack), "c int, lo bigint, hi bigint, shard int, base bigint")

    total = sum(counts.values())
    hot = [cell for cell, n in counts.items() if n * PARTS > total and n > 1]  # fewer than PARTS cells
    part = F.when(F.col("cell").isin(hot), F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))).otherwise(0) if hot else F.lit(0).cast("bigint")
    rows = rows.withColumn("part", part)
    sizes: dict[int, list[tuple[int, int]]] = {}
    for r in rows.filter(F.col("cell").isin(hot)).groupBy("cell", "part").agg(F.count("*").alias("n")).collect() if hot else ():  # fewer than PARTS ** 2
        sizes.setdefault(r.cell, []).append((r.part, r.n))
    before = [(cell, k, sum(n for j, n in parts if j < k)) for cell, parts in sizes.items() for k, _ in parts]
    first = spark.createDataFrame(before, "fc int, fp bigint, before bigint")

    order = Window.partitionBy("cell", "part").orderBy("place", "id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1)
    if hot:
        ranked = ranked.join(F.broadcast(first), (F.col("cell") == F.col("fc")) & (F.col("part") == F.col("fp")), "left")
        ranked = ranked.withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    hit = (F.col("cell") == F.col("c")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    out = ranked.join(F.broadcast(plan), hit)
    return out.select("id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))
