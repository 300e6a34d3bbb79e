"""Co-training of a text view and a metadata view (Blum and Mitchell, 1998).

The text view sees words and the style of the text; the metadata view sees
language, source and length.  Each is a logistic regression.  In every round both
score all unlabelled documents, and each hands its most confident ones, with their
predicted label, to the other's training set; none goes twice, copies count once, and
those on which the views disagree stay.  At last both are calibrated on labelled rows
that were held out, their log-odds are added, the sum is calibrated again, and all
documents are scored.

Bounds, all parameters: at most ``most_labelled`` labelled ids are fitted on (those
with the smallest hash), at most ``per_round`` pseudo-labels a view, class and round are
exchanged, and the vocabulary holds words of at least ``least`` labelled texts that tell
the classes apart by ``z`` standard errors or more, ``most_words`` at most for each target.
They bound what reaches the driver and what is broadcast.  Everything else covers all
documents; no labelled one is ever a candidate for a pseudo-label.

Defined cases: a null text is empty; a long text is one run of words; null metadata is a
value of its own; several labels of one id count by their mean (one half is one), a null
label is none; of several documents with one labelled id the one with the smallest hash
is learned from; labels of unknown ids are ignored; equally sure rows are taken by a hash
of their features; a target whose labels are all alike, or absent, gets its prior (one half
without any) everywhere; repeated rows and rows without ids are scored each; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textscan as ts

#: Characters whose share describes a text's style.
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*|!<>{}[]=~^_@\\"]] = True
_LEVELS = 12


_HASH = 40  # bits of a word's hash that name a feature


def _text_features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text (words, and four levels of style), and where each text's begin."""
    n = len(at) - 1
    words = ts.Words(ts.LOWER[raw], at, ts.NON_WORD)
    size = np.maximum(np.diff(at), 1)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    upper = total((raw >= 65) & (raw <= 90)) / size
    symbol = total(_SYMBOLS[raw]) / size
    key = np.sort(words.doc().astype(ts.U) << ts.U(_HASH) | words.hashes() >> ts.U(64 - _HASH))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    doc = (key >> ts.U(_HASH)).astype(np.int64)
    variety = np.bincount(doc, minlength=n) / np.maximum(words.counts, 1)
    levels = [np.minimum((x * _LEVELS * scale).astype(np.int64), _LEVELS) for x, scale in ((upper, 2), (symbol, 4), (variety, 1))]
    levels.append(np.minimum(np.log2(words.counts + 1).astype(np.int64), 24))
    style = np.stack([ts.mix((1000 * (k + 1) + x).astype(ts.U)) >> ts.U(64 - _HASH) for k, x in enumerate(levels)], 1)
    ends = np.searchsorted(doc, np.arange(n + 1))
    first = ends + len(levels) * np.arange(n + 1)
    out = np.empty(int(first[-1]), ts.U)
    place = np.ones(len(out), bool)
    slots = first[:-1, None] + np.arange(len(levels))
    place[slots.ravel()] = False
    out[slots.ravel()] = style.ravel()
    out[place] = key & ts.U((1 << _HASH) - 1)
    return out, first


def _meta_features(lang: list, source: list, n_chars: list) -> list[list[str]]:
    out = []
    for a, b, c in zip(lang, source, n_chars):
        size = "none" if c is None else str(int(max(c, 0) + 1).bit_length())
        out.append([f"lang={a}", f"source={b}", f"size={size}", f"lang={a} size={size}"])
    return out


class Logistic:
    """Weights of binary features, fitted by Adam on the whole (bounded) sample."""

    def __init__(self, width: int, l2: float = 1e-4, steps: int = 250, rate: float = 0.1):
        self.w, self.b, self.l2, self.steps, self.rate = np.zeros(width), 0.0, l2, steps, rate

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        size = np.array([len(r) for r in rows], np.int64)
        flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        return np.bincount(np.repeat(np.arange(len(rows)), size), self.w[flat], len(rows)) + self.b

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> Logistic:
        """Rows with equal features are one, with their number as weight and their mean as target."""
        place: dict[bytes, int] = {}
        which = np.array([place.setdefault(np.asarray(r, np.int32).tobytes(), len(place)) for r in rows], np.int64)
        rows = [np.frombuffer(k, np.int32) for k in place]
        weight = np.bincount(which, minlength=len(rows)).astype(float)
        mean = np.bincount(which, y, len(rows)) / weight
        size = np.array([len(r) for r in rows], np.int64)
        flat = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)
        owner, total = np.repeat(np.arange(len(rows)), size), weight.sum()
        m, v = np.zeros(len(self.w) + 1), np.zeros(len(self.w) + 1)
        for t in range(1, self.steps + 1):
            error = weight * (_sigmoid(np.bincount(owner, self.w[flat], len(rows)) + self.b) - mean)
            grad = np.append(np.bincount(flat, error[owner], len(self.w)) / total + self.l2 * self.w, error.sum() / total)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            step = self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            self.w, self.b = self.w - step[:-1], self.b - step[-1]
        return self


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into log-odds, with Platt's smoothed targets."""
    pos, neg = float(y.sum()), float((1 - y).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    at = np.array([1.0, 0.0])

    def loss(x: np.ndarray) -> float:
        z = x[0] * score + x[1]
        return float((np.logaddexp(0, z) - target * z).sum() + 5e-4 * (x[0] - 1) ** 2)

    for _ in range(50):  # Newton's method, each step halved until it helps
        p = _sigmoid(at[0] * score + at[1])
        g = np.array([((p - target) * score).sum() + 1e-3 * (at[0] - 1), (p - target).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * score**2).sum() + 1e-3, (s * score).sum()], [(s * score).sum(), s.sum()]])
        step, now = np.linalg.solve(h + 1e-9 * np.eye(2), g), loss(at)
        while np.abs(step).max() > 1e-9 and loss(at - step) > now:
            step = step / 2
        at = at - step
        if np.abs(step).max() < 1e-9:
            break
    a, b = at.tolist()
    return max(a, 0.0), b


def _lookup(vocabulary: np.ndarray, h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    if not len(vocabulary):
        return [np.zeros(0, np.int64)] * (len(first) - 1)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    hit = vocabulary[at] == h
    cut, found = np.concatenate([[0], np.cumsum(hit)])[first], at[hit]
    return [found[a:b] for a, b in zip(cut[:-1], cut[1:])]


class View:
    """One view's training rows and model for one target."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, width: int, held: tuple[list[np.ndarray], np.ndarray]):
        self.rows, self.y, self.width, self.held = list(rows), list(y), width, held

    def train(self, again: int = 80) -> View:
        """Fit; a later fit starts from the one before and takes ``again`` steps."""
        before = getattr(self, "model", None)
        model = Logistic(self.width) if before is None else Logistic(self.width, steps=again, rate=0.05)
        if before is not None:
            model.w, model.b = before.w, before.b
        self.model = model.fit(self.rows, np.array(self.y, float))
        self.slope, self.offset = platt(self.model.raw(self.held[0]), self.held[1])
        return self

    def odds(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.slope * self.model.raw(rows) + self.offset

    def numbers(self) -> tuple:
        return self.model.w, self.model.b, self.slope, self.offset


def _odds(numbers: tuple, rows: list[np.ndarray]) -> np.ndarray:
    w, b, slope, offset = numbers
    model = Logistic(len(w))
    model.w, model.b = w, b
    return slope * model.raw(rows) + offset


_META = "lang string, source string, n_chars bigint"
_NAMES = [c.split()[0] for c in _META.split(", ")]


@dataclass
class Fitted:
    """Features and models of :func:`fit`; bounded by its parameters, whatever the input."""

    targets: tuple[str, ...]
    words: np.ndarray
    columns: dict[str, int]
    prior: dict[str, float]
    views: dict[str, tuple]  # target -> numbers of both views, and of the calibrated sum

    def features(self, raw: np.ndarray, at: np.ndarray, meta: list[list]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        text = _lookup(self.words, *_text_features(raw, at))
        return text, [np.array([self.columns[x] for x in r if x in self.columns], np.int32) for r in _meta_features(*meta)]

    def probabilities(self, text: list[np.ndarray], meta: list[np.ndarray], views: tuple[int, ...] = (0, 1)) -> list[np.ndarray]:
        """Of each target; of one view alone if asked."""
        out = []
        for t in self.targets:
            if t not in self.views:
                out.append(np.full(len(text), self.prior[t]))
                continue
            pair, base, (slope, offset) = self.views[t]
            each = [_odds(pair[k], (text, meta)[k]) for k in views]
            out.append(_sigmoid(slope * (sum(each) - base) + offset if len(views) > 1 else each[0]))
        return out


def _rows(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    meta = [F.col(c).cast(t).alias(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _META.split(", "))]
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), *meta, *more)


def _vocabulary(labelled: DataFrame, targets: tuple[str, ...], least: int, most: int, z: float) -> np.ndarray:
    """Features that tell the classes of any target apart by their smoothed log-odds.

    Counted in Spark; ``most`` a target reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in ts.chunks(batch, "t"):
                h, first = _text_features(raw, at)
                owner = np.repeat(np.arange(part.num_rows), np.diff(first))
                values, back = np.unique(h, return_inverse=True)
                sums = []
                for k in range(len(targets)):
                    y = part.column(1 + k).to_numpy(zero_copy_only=False).astype(float)[owner]
                    sums += [np.bincount(back, y == v, len(values)).astype(np.int64) for v in (1.0, 0.0)]
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), *map(pa.array, sums)], ["h", *(f"n{k}_{v}" for k in range(len(targets)) for v in (1, 0))])

    names = [f"n{k}_{v}" for k in range(len(targets)) for v in (1, 0)]
    made = labelled.select("t", *(f"y_{t}" for t in targets)).mapInArrow(common.lean(count), "h bigint, " + ", ".join(f"{c} bigint" for c in names))
    counted = common.materialise(made.groupBy("h").agg(*(F.sum(c).alias(c) for c in names)).coalesce(8), "words")  # of the labelled rows
    sizes = labelled.agg(*(F.count_if(F.col(f"y_{t}") == v) for t in targets for v in (1, 0))).first()
    found = [np.zeros(0, ts.U)]
    for k in range(len(targets)):
        n1, n0 = sizes[2 * k], sizes[2 * k + 1]
        if not n1 or not n0:
            continue
        one, two = F.col(f"n{k}_1"), F.col(f"n{k}_0")
        odds = F.log((one + 0.5) / (F.lit(n1) - one + 0.5)) - F.log((two + 0.5) / (F.lit(n0) - two + 0.5))
        strength = F.abs(odds) / F.sqrt(1 / (one + 0.5) + 1 / (two + 0.5))
        seen = sum((F.col(c) for c in names[2 * k : 2 * k + 2]), F.lit(0))
        best = counted.filter(seen >= least).select("h", strength.alias("z")).filter(F.col("z") > z).orderBy(F.desc("z"), "h").limit(most)
        found.append(np.array([r.h for r in best.collect()], np.int64).view(ts.U))
    return np.unique(np.concatenate(found))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    targets: tuple[str, ...] = ("quality", "toxic"),
    rounds: int = 2,
    per_round: int = 200,
    confidence: float = 0.95,
    most_labelled: int = 20_000,
    least: int = 5,
    most_words: int = 2_000,
    z: float = 3.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[Fitted, DataFrame]:
    """The models, and the features ``id, a, b`` of all documents as written."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _rows(docs, id_col, text_col)
    marked = labels.select(F.col(id_col).alias("id"), *(F.col(t).cast("double").alias(f"y_{t}") for t in targets)).filter("id is not null")
    # a mean of one half counts as one
    marked = marked.groupBy("id").agg(*((F.avg(f"y_{t}") >= 0.5).cast("double").alias(f"y_{t}") for t in targets))
    sample = marked.orderBy(F.xxhash64("id"), "id").limit(most_labelled)
    one = F.min_by(F.struct("t", *_NAMES), F.struct(F.xxhash64("t", *_NAMES), "t")).alias("x")  # of rows with one id
    labelled = rows.join(F.broadcast(sample), "id").groupBy("id").agg(one, *(F.max(f"y_{t}").alias(f"y_{t}") for t in targets))
    labelled = common.materialise(labelled.select("id", "x.*", *(f"y_{t}" for t in targets)).coalesce(8), "labelled")  # most_labelled rows
    words = _vocabulary(labelled, targets, least, most_words, z)

    fitted = Fitted(targets, words, {}, {}, {})
    shown = spark.sparkContext.broadcast(fitted)  # bounded by most_words

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in ts.chunks(batch, "t"):
                text = pa.array([x.astype(np.int32).tobytes() for x in _lookup(shown.value.words, *_text_features(raw, at))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], text], [part.schema.names[0], *part.schema.names[2:], "f"])

    ys = ", ".join(f"y_{t} double" for t in targets)
    known = labelled.select("id", "t", *_NAMES, *(f"y_{t}" for t in targets)).mapInArrow(common.lean(learn), f"id {kind}, {_META}, {ys}, f binary")
    known = known.orderBy(F.xxhash64("id"), "id").collect()  # most_labelled rows of at most 8 * most_words * len(targets) bytes
    truth = {t: np.array([np.nan if r[f"y_{t}"] is None else r[f"y_{t}"] for r in known]) for t in targets}
    text_rows = [np.frombuffer(r.f, np.int32) for r in known]
    names = _meta_features([r.lang for r in known], [r.source for r in known], [r.n_chars for r in known])
    fitted.columns.update({x: i for i, x in enumerate(sorted({x for r in names for x in r}))})
    meta_rows = [np.array([fitted.columns[x] for x in r], np.int32) for r in names]
    sent = spark.sparkContext.broadcast(fitted)  # bounded by most_words and most_labelled

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in ts.chunks(batch, "t"):
                found = sent.value.features(raw, at, [part.column(c).to_pylist() for c in (2, 3, 4)])
                packed = [pa.array([x.astype(np.int32).tobytes() for x in f], pa.binary()) for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), *packed], ["id", "a", "b"])

    table = common.materialise(common.fewer(rows).mapInArrow(common.lean(featurise), f"id {kind}, a binary, b binary"), "features")
    check = np.arange(len(known)) % 5 == 0  # held out for calibration
    views: dict[str, tuple[View, View]] = {}
    for t in targets:
        told = ~np.isnan(truth[t])
        fitted.prior[t] = float(truth[t][told].mean()) if told.any() else 0.5
        learned, held = np.flatnonzero(told & ~check), np.flatnonzero(told & check)
        if len({*truth[t][learned]}) < 2 or len({*truth[t][held]}) < 2:
            continue
        sides = ((text_rows, len(words)), (meta_rows, len(fitted.columns)))
        views[t] = tuple(View([r[i] for i in learned], truth[t][learned], n, ([r[i] for i in held], truth[t][held])).train() for r, n in sides)

    if views and rounds:
        free = table.join(marked.select("id"), "id", "left_anti").select("a", "b").distinct()  # copies count once
        free = free.withColumn("tie", F.xxhash64("a", "b"))
        free = common.materialise(free.coalesce(max(table.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)), "unlabelled")
        taken: dict[str, set] = {t: set() for t in views}
        for _ in range(rounds):
            handed = _exchange(free, views, taken, per_round, float(np.log(confidence / (1 - confidence))))
            for t, pair in views.items():
                for k, label, a, b in handed[t]:
                    taken[t].add((a, b))
                    pair[1 - k].rows.append(np.frombuffer(b if k == 0 else a, np.int32))
                    pair[1 - k].y.append(float(label))
                for view in pair if handed[t] else ():
                    view.train()

    for t, pair in views.items():
        base = np.log(fitted.prior[t] / (1 - fitted.prior[t]))
        joint = sum(v.odds(v.held[0]) for v in pair) - base
        fitted.views[t] = ([v.numbers() for v in pair], base, platt(joint, pair[0].held[1]))
    return fitted, table


def _exchange(free: DataFrame, views: dict, taken: dict, per_round: int, bar: float) -> dict[str, list]:
    """For each target what either view is surest of: view, label, and both views' features.

    No row is handed over twice for a target, and none on whose label the views disagree.
    """
    now = free.sparkSession.sparkContext.broadcast(({t: [v.numbers() for v in pair] for t, pair in views.items()}, taken))

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each task's most confident rows by target, view and class."""
        best: dict[tuple, list] = {}
        models, gone = now.value
        for batch in batches:
            packed = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cols = [[np.frombuffer(x, np.int32) for x in c] for c in packed]
            tie = batch.column(2).to_numpy(zero_copy_only=False)
            for t, pair in models.items():
                for k, numbers in enumerate(pair):
                    odds = _odds(numbers, cols[k])
                    for label in (0, 1):
                        s = odds if label else -odds
                        order = np.flatnonzero(s >= bar)
                        order = order[np.lexsort((tie[order], -s[order]))]
                        mine, room = best.setdefault((t, k, label), []), per_round
                        for i in order.tolist():
                            if room and (packed[0][i], packed[1][i]) not in gone[t]:
                                mine.append((float(s[i]), int(tie[i]), packed[0][i], packed[1][i]))
                                room -= 1
                        mine.sort(key=lambda x: (-x[0], *x[1:]))
                        del mine[per_round:]
        flat = [(t, k, label, *x) for (t, k, label), xs in best.items() for x in xs]
        types = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary()]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*flat), types)], ["target", "view", "label", "odds", "tie", "a", "b"])

    found = free.mapInArrow(common.lean(sure), "target string, view int, label int, odds double, tie bigint, a binary, b binary")
    found = common.materialise(found.repartition(max(8, free.rdd.getNumPartitions() // 64)), "confident")  # a few rows a task
    parts = [found.filter((F.col("target") == t) & (F.col("view") == k) & (F.col("label") == y)).orderBy(F.desc("odds"), "tie", "a", "b").limit(per_round) for t in views for k in (0, 1) for y in (0, 1)]
    out: dict[str, dict] = {t: {} for t in views}
    for r in reduce(DataFrame.unionByName, parts).collect():  # per_round rows a target, view and class
        out[r.target].setdefault((bytes(r.a), bytes(r.b)), []).append((r.view, r.label))
    return {t: [(k, y, a, b) for (a, b), said in found.items() if len({y for _, y in said}) == 1 for k, y in said] for t, found in out.items()}


def co_train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``id`` and the probability of each target for every document; for the parameters see :func:`fit`."""
    fitted, table = fit(docs, labels, id_col=id_col, text_col=text_col, **more)
    sent = docs.sparkSession.sparkContext.broadcast(fitted)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[np.frombuffer(x, np.int32) for x in c.to_pylist()] for c in batch.columns[1:3]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sent.value.probabilities(*cols))], ["id", *sent.value.targets])

    return table.mapInArrow(common.lean(score), f"id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{t} double" for t in fitted.targets))


def classify(docs: DataFrame, fitted: Fitted, views: tuple[int, ...] = (0, 1), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as a struct ``row``, and the probability of each target: one pass, no shuffle, no ids needed."""
    rows = _rows(docs, id_col, text_col, F.struct(*(F.col(c) for c in docs.columns)).alias("row"))
    sent = docs.sparkSession.sparkContext.broadcast(fitted)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in ts.chunks(batch, "t"):
                found = sent.value.features(raw, at, [part.column(c).to_pylist() for c in (1, 2, 3)])
                yield pa.RecordBatch.from_arrays([part.column(4), *map(pa.array, sent.value.probabilities(*found, views))], ["row", *sent.value.targets])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.select("t", *_NAMES, "row").mapInArrow(common.lean(score), f"row {kind}, " + ", ".join(f"{t} double" for t in fitted.targets))
