"""Scoring by an n-gram model whose counts live in a log-frequency Bloom filter.

After Talbot and Osborne (2007): an n-gram counted ``c`` times has a quantised count
``q``, the number of levels 1, 2, 3, 4, 6, 8, 12, 16, ... that ``c`` reaches, and the filter
holds it with each of 1 .. q.  A look-up probes 1, 2, ... until a probe fails; the last
success is the quantised count.  The first level takes ``words`` words of 64 bits with
eight bits each, the levels above one word, and the filter has ``density`` times as many
bits as are set, so an n-gram that was never counted passes the first level with a
probability of about ``2 ** (-6 * words)``; the actual rate ``f`` is measured on each part.

*The score is a probability.*  With ``c(h)`` the count of the context, the probability of
``w`` after ``h`` is

    l * count / (c(h) + guard) + (1 - l) * P(w, shorter context),  l = weight * c(h) / (c(h) + 1)

where ``P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))`` for single tokens, whose counts are exact.
``count`` is the lower end of the level reached, zero if ``w`` or ``h`` was never counted, and
never above the counts of ``w``, of ``h`` and of the shorter n-gram.  ``guard`` bounds the
false positives that a context can have: their number over the whole vocabulary is Poisson
with mean ``f V`` (for longer contexts: ``f`` times the followers of the shorter context),
and the guard is its quantile at one in a million.  So the counts after a context sum to
``c(h) + guard`` at most, and the probabilities to one at most, for all contexts but one in
a million.

Counting: tasks pack sorted runs of 64-bit hashes, dealt by leading bits into segments
that grow in number with the text; each segment builds its own part of the model.  The
model is a table in the shared folder and is broadcast in groups of at most
``group_bytes``: if it is larger than that, the texts pass once for each group, and each
pass fills in what its group knows, one byte a token and order (and the exact counts,
if single tokens need more than one group).

Defined cases: a null text is empty; every text ends with one end token, which also
is the context of the first word; a null id is never held out; repeated rows are
counted and scored each; a long text is one run of words and needs its task's memory
about a hundred times; without training texts every score is zero; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, segments
from . import textscan as ts

END = ts.mix(np.array([0x656E64], ts.U))[0]
#: 1, 2, 3, 4, 6, 8, 12, 16, ...: the counts at which a level begins.
LEVELS = np.array(sorted({1} | {x << k for k in range(61) for x in (2, 3)}), np.int64)
_BITS = 8  # set in a word for each probe
_RARE = 1e-6
_CHUNK = 1 << 18  # bytes of text worked on at once; arrays of tokens take about twenty times as much


def _masks() -> np.ndarray:
    """4096 words with eight bits set, by a fixed rule."""
    order = np.argsort(ts.mix(np.arange(4096 * 64, dtype=ts.U)).reshape(4096, 64), 1)[:, :_BITS]
    return np.bitwise_or.reduce(ts.U(1) << order.astype(ts.U), 1)


MASKS = _masks()


def _tokens(raw: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Hashes of all tokens, for 2 .. order those of the n-grams that end in them, and tokens of each text.

    The context of a first word is the end token; n-grams that would reach further back are zero.
    """
    words = ts.Words(ts.LOWER[raw], at)
    counts = words.counts
    out = np.full(len(words) + len(counts), END)
    out[np.arange(len(words)) + words.doc()] = words.hashes()
    size = counts + 1
    place = np.arange(len(out)) - np.repeat(np.cumsum(size) - size, size)
    before = np.where(place > 0, np.roll(out, 1), END)
    grams = [ts.mix(ts.mix(before ^ ts._GOLD) ^ out)]
    for m in range(3, order + 1):
        longer = ts.mix(ts.mix(np.roll(grams[-1], 1) + ts.U(m) * ts._C2) ^ out)
        grams.append(np.where(place >= m - 2, longer, ts.U(0)))
    return out, grams, size


def _count(bits: int, order: int):
    """Packed runs; the segments of n-grams follow those of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, more = segments.Packer(bits, 1 << 20), segments.Packer(bits, 1 << 20)
        shift = lambda made: (b.set_column(0, "seg", pa.array(b.column(0).to_numpy() + (1 << bits))) for b in made)
        for batch in batches:
            for _, raw, at in ts.chunks(batch, "t", _CHUNK):
                tokens, grams, _ = _tokens(raw, at, order)
                yield from ones.add(tokens)
                for g in grams:
                    yield from shift(more.add(g[g != 0]))
        yield from ones.flush()
        yield from shift(more.flush())

    return run


def quantise(counts: np.ndarray) -> np.ndarray:
    """The number of levels that each count reaches."""
    return np.searchsorted(LEVELS, counts, "right")


def _places(hashes: np.ndarray, level: int, size, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word and mask of each probe of an n-gram at a level, in a part of ``size`` words."""
    x = ts.mix(hashes + ts.U(level * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
    for _ in range(words if level == 1 else 1):
        yield (x % np.asarray(size).astype(ts.U)).astype(np.int64), MASKS[(x >> ts.U(52)).astype(np.int64)]
        x = ts.mix(x)


def _part(bits: int, words: int, density: float):
    """One segment's part of the model: exact counts of tokens, or a filter of n-grams."""

    def run(seg: int, table: pa.Table) -> pa.Table:
        values, counts = segments.merge(table)
        total, distinct, passed = int(counts.sum()), len(values), 0.0
        if seg < 1 << bits:
            kind = np.uint32 if counts.max() < 1 << 32 else np.uint64
            one, two = values.tobytes(), counts.astype(kind).tobytes()
        else:
            q = quantise(counts)
            probes = words * len(q) + int((q - 1).sum())
            made = np.zeros(max(1, math.ceil(probes * _BITS * density / 64)), ts.U)
            for level in range(1, int(q.max()) + 1):
                for at, mask in _places(values[q >= level], level, np.int64(len(made)), words):
                    np.bitwise_or.at(made, at, mask)
            sample = np.arange(1, 1 << 15, dtype=ts.U)
            at, mask = next(_places(sample, 0, np.int64(len(made)), words))
            passed = float(((made[at] & mask) == mask).mean()) ** words
            one, two = made.tobytes(), b""
        return pa.table(
            {
                "seg": pa.array([seg], pa.int32()),
                "one": pa.array([one], pa.binary()),
                "two": pa.array([two], pa.binary()),
                "total": pa.array([total]),
                "distinct": pa.array([distinct]),
                "passed": pa.array([passed]),
            }
        )

    return run


def _load(rows: list, bits: int) -> dict:
    """Look-up arrays of a group of segments; segments that are elsewhere have size zero."""
    n = 1 << bits
    one = sorted((r for r in rows if r.seg < n), key=lambda r: r.seg)
    counts = [np.frombuffer(r.two, np.uint32 if len(r.two) * 2 == len(r.one) else np.uint64) for r in one]
    size = np.zeros(n, np.int64)
    for r in rows:
        if r.seg >= n:
            size[r.seg - n] = len(r.one) // 8
    two = sorted((r for r in rows if r.seg >= n), key=lambda r: r.seg)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return {
        "tokens": join([np.frombuffer(r.one, ts.U) for r in one], ts.U),
        "counts": join(counts, np.uint32),
        "words": join([np.frombuffer(r.one, ts.U) for r in two], ts.U),
        "size": size,
        "base": np.cumsum(size) - size,
    }


def _exact(model: dict, hashes: np.ndarray) -> np.ndarray:
    known = model["tokens"]
    if not len(known):
        return np.zeros(len(hashes), np.int64)
    distinct, back = np.unique(hashes, return_inverse=True)
    at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
    return np.where(known[at] == distinct, model["counts"][at], 0).astype(np.int64)[back]


def _quantised(model: dict, hashes: np.ndarray, bits: int, words: int) -> np.ndarray:
    """The last level whose probes all succeed."""
    seg = (hashes >> ts.U(64 - bits)).astype(np.int64)
    out = np.zeros(len(hashes), np.uint8)
    live, level = np.flatnonzero((model["size"][seg] > 0) & (hashes != 0)), 1
    while len(live):
        own, rest = seg[live], np.arange(len(live))
        for at, mask in _places(hashes[live], level, model["size"][own], words):
            rest = rest[(model["words"][model["base"][own[rest]] + at[rest]] & mask[rest]) == mask[rest]]
        live = live[rest]
        out[live] = level
        level += 1
    return out


def guard(mean: np.ndarray) -> np.ndarray:
    """The number that a Poisson variable exceeds with a probability of one in a million at most."""
    mean = np.asarray(mean, float)
    return np.where(mean > _MEANS[-1], np.ceil(mean + 6 * np.sqrt(np.maximum(mean, 0)) + 6), np.searchsorted(_MEANS, mean, "left"))


def _poisson_means(most: int = 40) -> np.ndarray:
    """For 0, 1, ...: the largest mean of a Poisson variable that seldom exceeds the number."""

    def beyond(mean: float, b: int) -> float:
        return sum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(b + 1, b + 60))

    out = []
    for b in range(most):
        low, high = 0.0, 60.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if beyond(mid, b) <= _RARE else (low, mid)
        out.append(low)
    return np.array(out)


_MEANS = _poisson_means()


def probabilities(c: np.ndarray, qs: list[np.ndarray], size: np.ndarray, n_train: int, n_kinds: int, passed: float, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each token by itself, and by the model; see the module's text."""
    first = np.cumsum(size) - size
    place = np.arange(len(c)) - np.repeat(first, size)
    base = (c + 0.5) / (n_train + 0.5 * (n_kinds + 1))
    context = np.roll(c, 1)
    context[first] = c[first + size - 1]  # every text ends with the end token
    context, extra = context.astype(float), guard(np.array([passed * n_kinds]))[0]
    extra = np.full(len(c), extra)
    count, out = c.astype(float), base
    for m, q in enumerate(qs, 2):
        if m > 2:
            followers = context + extra
            reached = np.where(place >= m - 2, np.roll(qs[m - 3], 1) * np.roll(count > 0, 1), 0).astype(np.int64)
            context = np.where(reached > 0, LEVELS[reached] - 1, 0).astype(float)  # the upper end of the level
            extra = guard(passed * followers)
        lower = LEVELS[np.maximum(q, 1).astype(np.int64) - 1].astype(float)
        count = np.where((q > 0) & (count > 0) & (context > 0), np.minimum(np.minimum(lower, count), context), 0.0)
        share = weight * context / (context + 1)
        out = share * count / np.maximum(context + extra, 1) + (1 - share) * out
    return base, out


def score_texts(
    docs: DataFrame,
    train: Column,
    order: int = 2,
    weight: float = 0.8,
    words: int = 3,
    density: float = 1.25,
    group_bytes: int = 100 << 20,
    per_token: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id, trained, n_tokens, n_known, train_tokens, base_score, score`` of each text.

    ``train`` tells which rows the model learns from (null: all it is not false for).
    Scores are log10 probabilities: ``base_score`` of single tokens, ``score`` of the
    n-gram model; with ``per_token`` an array ``logs`` holds the latter token by token.
    """
    if order < 2:
        raise ValueError("the order of the model is two at least")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(True)).alias("trained"), text.alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bits = segments.segment_bits(size)
    with common.small_batches(spark):
        return _scored(rows, kind, bits, order, weight, words, density, group_bytes, per_token)


def _scored(rows: DataFrame, kind: str, bits: int, order: int, weight: float, words: int, density: float, group_bytes: int, per_token: bool) -> DataFrame:
    spark = rows.sparkSession
    packed = rows.filter("trained").select("t").mapInArrow(_count(bits, order), segments.SCHEMA)
    schema = "seg int, one binary, two binary, total bigint, distinct bigint, passed double"
    model = common.materialise(segments.by_segment(packed, _part(bits, words, density), schema), "model")
    sized = list(model.select("seg", "total", "distinct", "passed", (F.length("one") + F.length("two")).alias("bytes")).orderBy(F.desc("seg")).toLocalIterator())  # one row a segment
    tokens = [r for r in sized if r.seg < 1 << bits]
    n_train, n_kinds = sum(r.total for r in tokens), sum(r.distinct for r in tokens)
    passed = sum(r.passed for r in sized) / (1 << bits)  # an n-gram that was never counted meets any part
    whole = sum(r.bytes for r in sized)
    limit = whole / max(1, -(-whole // group_bytes))  # groups of like size, tokens last
    groups, held = [[]], 0
    for r in sized:
        if groups[-1] and held + r.bytes / 2 > limit * len(groups):
            groups.append([])
        groups[-1].append(r.seg)
        held += r.bytes

    state = rows.withColumns({"c": F.lit(None).cast("binary"), "q": F.lit(None).cast("binary")})
    before = None
    for i, group in enumerate(groups):
        part = list(model.filter(F.col("seg").isin(group)).toLocalIterator()) if group else []
        exact = any(r.seg < 1 << bits for r in part)
        sent = spark.sparkContext.broadcast(_load(part, bits))
        del part
        if i + 1 < len(groups):
            filled = state.mapInArrow(_fill(sent, bits, words, order, exact), f"id {kind}, trained boolean, t string, c binary, q binary")
            state = common.materialise(filled, "filled")
            sent.destroy()
            if before:
                common.release(spark, [before])
            before = common.written(spark)[-1]
    run = _score(sent, bits, words, order, weight, n_train, n_kinds, passed, per_token)
    schema = f"id {kind}, trained boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    scored = common.materialise(state.mapInArrow(run, schema + (", logs array<double>" if per_token else "")), "scored")
    sent.destroy()  # else executors keep a group of the model after the query
    if before:
        common.release(spark, [before])
    return scored


def _known(part: pa.RecordBatch, raw: np.ndarray, at: np.ndarray, model: dict, bits: int, words: int, order: int):
    """Counts of the tokens and levels of the n-grams, of this and earlier groups."""
    tokens, grams, sizes = _tokens(raw, at, order)
    c, qs = _exact(model, tokens), [_quantised(model, g, bits, words) for g in grams]
    if part.column(3).null_count == 0:
        c = c + np.frombuffer(b"".join(part.column(3).to_pylist()), np.int64)
    if part.column(4).null_count == 0:
        earlier = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8).reshape(-1, order - 1)
        qs = [q + earlier[:, k] for k, q in enumerate(qs)]
    return c, qs, sizes


def _fill(sent, bits: int, words: int, order: int, exact: bool):
    """Texts with what this group knows of their tokens; counts are kept once a group has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in ts.chunks(batch, "t", _CHUNK):
                c, qs, sizes = _known(part, raw, at, sent.value, bits, words, order)
                cut = np.cumsum(sizes)[:-1]
                keep = exact or part.column(3).null_count == 0
                cs = pa.array([x.tobytes() for x in np.split(c, cut)], pa.binary()) if keep else pa.nulls(part.num_rows, pa.binary())
                ql = pa.array([x.tobytes() for x in np.split(np.stack(qs, 1), cut)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], cs, ql], ["id", "trained", "t", "c", "q"])

    return run


def _score(sent, bits: int, words: int, order: int, weight: float, n_train: int, n_kinds: int, passed: float, per_token: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in ts.chunks(batch, "t", _CHUNK):
                c, qs, sizes = _known(part, raw, at, sent.value, bits, words, order)
                first = np.cumsum(sizes) - sizes
                single, mixed = probabilities(c, qs, sizes, n_train, n_kinds, passed, weight)
                logs = np.log10(mixed)
                total = lambda x: np.add.reduceat(x, first)
                arrays = [part.column(0), part.column(1), pa.array(sizes.astype(np.int64)), pa.array(total((c > 0).astype(np.int64)))]
                arrays += [pa.array(np.full(len(sizes), n_train, np.int64)), pa.array(total(np.log10(single))), pa.array(total(logs))]
                names = ["id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                if per_token:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(c)).astype(np.int32)), pa.array(logs)))
                    names.append("logs")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run
