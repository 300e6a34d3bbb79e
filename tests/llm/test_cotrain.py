import random

import numpy as np
from pyspark.sql import functions as F

from loomaudit.llm import cotrain


def make(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        bad, junk = rng.random() < 0.15, rng.random() < 0.2
        ws = rng.choices(words, k=rng.randint(20, 80))
        if bad:
            ws[rng.randrange(len(ws))] = rng.choice(["idiot", "scum", "trash"])
        if junk:
            ws = [w.upper() + "$$$" for w in ws]
        source = "spam" if junk and rng.random() < 0.8 else rng.choice(["s1", "s2"])
        docs.append((i, " ".join(ws), "en", source, len(" ".join(ws))))
        labels.append((i, int(not junk), int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = make(1500, 1)
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({"id": F.lit("x"), "a": F.lit(1), "t": F.lit(None)})
    known = spark.createDataFrame(labels[:700], "doc_id bigint, quality int, toxic int")
    got = {r.id: r for r in cotrain.co_train(df, known, per_round=40).collect()}
    assert len(got) == 1500
    for target, k in (("quality", 1), ("toxic", 2)):
        right = [(got[i][target] >= 0.5) == bool(row[k]) for i, row in enumerate(labels) if i >= 700]
        assert np.mean(right) > 0.97, target


def test_platt_and_logistic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=2000)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    a, b = cotrain.platt(x, y)
    assert abs(a - 2) < 0.3 and abs(b + 1) < 0.3


def test_edge_cases(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    none = spark.createDataFrame([], schema)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (None, 1, 1), (99, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert cotrain.co_train(none, labels).count() == 0
    docs = spark.createDataFrame([(1, "a", "en", None, None), (1, "a", "en", None, None), (None, None, None, None, None)], schema)
    got = cotrain.co_train(docs, labels).collect()
    assert sorted((r.id or 0, r.quality, r.toxic) for r in got) == [(0, 1.0, 0.0), (1, 1.0, 0.0), (1, 1.0, 0.0)]
    bare = cotrain.co_train(docs.select("doc_id", "text"), labels.limit(0)).collect()
    assert {r.quality for r in bare} == {0.5}


def two_views(n, seed):
    """Each view alone is noisy; what one is sure of teaches the other its rare signs."""
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        good = rng.random() < 0.5
        signs = [f"{'g' if good else 'b'}{rng.randrange(40)}" for _ in range(2)] if rng.random() < 0.9 else []
        source = f"{'x' if good == (rng.random() < 0.95) else 'y'}{rng.randrange(6)}"
        ws = rng.choices([f"w{j}" for j in range(60)], k=30) + signs
        rng.shuffle(ws)
        docs.append((i, " ".join(ws), "en", source, 100))
        labels.append((i, int(good)))
    return docs, labels


def test_exchange_helps_and_both_views_beat_each(spark):
    docs, labels = two_views(3000, 3)
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    known = spark.createDataFrame(labels[:150], "doc_id bigint, quality int")
    truth = {i: bool(y) for i, y in labels[150:]}
    few = {"targets": ("quality",), "least": 1, "z": 0.8, "most_words": 400, "confidence": 0.9}

    def accuracy(fitted, views):
        rows = cotrain.classify(df, fitted, views).select("row.doc_id", "quality").collect()
        return np.mean([(r.quality >= 0.5) == truth[r.doc_id] for r in rows if r.doc_id in truth])

    alone, _ = cotrain.fit(df, known, rounds=0, **few)
    taught, _ = cotrain.fit(df, known, rounds=4, per_round=150, **few)
    text, meta, both = accuracy(taught, (0,)), accuracy(taught, (1,)), accuracy(taught, (0, 1))
    assert text > accuracy(alone, (0,)) + 0.01  # the fit of the text view has changed, for the better
    assert both > max(text, meta) and both > 0.95
    assert not np.array_equal(alone.views["quality"][0][0][0], taught.views["quality"][0][0][0])


def test_nothing_is_handed_over_twice(spark):
    docs, labels = two_views(400, 4)
    df = spark.createDataFrame(docs + docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    fitted, table = cotrain.fit(df, spark.createDataFrame(labels[:100], "doc_id bigint, quality int"), targets=("quality",), rounds=0, least=1, z=0.8)
    width = (len(fitted.words), len(fitted.columns))
    pair = []
    for k in (0, 1):
        view = cotrain.View([], np.zeros(0), width[k], ([], np.zeros(0)))
        view.model = cotrain.Logistic(width[k])
        view.model.w, view.model.b, view.slope, view.offset = fitted.views["quality"][0][k]
        pair.append(view)
    free, taken, seen = table.select("a", "b", F.xxhash64("a", "b").alias("tie")).distinct(), {"quality": set()}, set()
    for _ in range(3):
        got = cotrain._exchange(free, {"quality": tuple(pair)}, taken, 20, 0.5)["quality"]
        rows = {(a, b) for _, _, a, b in got}
        assert rows and not rows & seen
        assert len({(k, a, b) for k, _, a, b in got}) == len(got)
        seen |= rows
        taken["quality"] |= rows


def test_classify_agrees_and_keeps_rows_without_ids(spark):
    docs, labels = make(300, 2)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    extra = [(None, "idiot " * 3, None, None, None), (None, None, "en", "s1", 0), (5, "another text", "en", "s1", 12), (5, "x " * 60_000, "en", "s1", 9)]
    df = spark.createDataFrame(docs + extra, schema).withColumns({c: F.lit("x") for c in ("row", "t", "id", "f", "quality")})
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    fitted, _ = cotrain.fit(df, known)
    got = cotrain.classify(df, fitted).select("row.*", "toxic").collect()
    assert len(got) == 304 and {r.t for r in got} == {"x"}
    want = sorted(round(r.toxic, 9) for r in cotrain.co_train(df, known).collect())
    assert sorted(round(r.toxic, 9) for r in got) == want
