import random
import re

import pytest
from pyspark.sql import functions as F

from loomaudit.llm.decontam import clean, contamination

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items, k):
    wins = {}
    for i, t in items:
        w = split(t)
        size = min(len(w), k)
        for s in range(len(w) - size + 1) if size else ():
            wins.setdefault(tuple(w[s : s + size]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, met = split(t), set(), set()
        for size in {len(x) for x in wins}:
            for s in range(len(w) - size + 1):
                if (own := wins.get(tuple(w[s : s + size]))) is not None:
                    hit.update(range(s, s + size))
                    met |= own
        out[d] = (len(w), hit, sorted(met))
    return out


@pytest.mark.parametrize("block", [16 << 20, 512])
def test_against_brute_force(spark, block):
    rng = random.Random(block)
    vocab = [f"w{i}" for i in range(60)] + ["É", "ß", "A1"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 30)))) for i in range(14)] + [(99, None), (98, "solo"), (12, "w1 w2"), (5, "!!")]
    docs = [(0, None), (1, ""), (2, "?!"), (3, "SOLO"), (4, "x solo-y"), (5, "w1--W2 w1")]
    for d in range(6, 50):
        parts = []
        for _ in range(rng.randint(0, 5)):
            w = split(rng.choice(items)[1])
            parts.append(b" ".join(w[rng.randint(0, 3) :]).decode().upper() if rng.random() < 0.5 else " ".join(rng.choices(vocab, k=rng.randint(1, 30))))
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(parts)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"id": F.lit("x"), "spans": F.lit(1), "t": F.lit(None)})
    got = contamination(df.repartition(3), spark.createDataFrame(items, "item_id bigint, text string"), 10, block).collect()
    want = brute(docs, items, 10)
    left = {r.doc_id: r.t for r in clean(df.repartition(3), spark.createDataFrame(items, "item_id bigint, text string"), 10, block).collect()}
    assert left == {d: None for d, (_, hit, _) in want.items() if not hit}
    assert len(got) == len(docs)
    for r in got:
        n, hit, met = want[r.id]
        assert (r.n_words, r.n_hit, r["items"]) == (n, len(hit), met), r.id
        assert {j for s in r.spans for j in range(s.start, s.end)} == hit


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in contamination(docs, none).collect()] == [(3, 0, [])] * 2
    assert contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).count() == 0


def test_null_and_repeated_ids_and_ties(spark):
    items = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "x y z"), (1, "x y z")], "item_id bigint, text string")
    rows = [(None, "q a b c d"), (None, "clean"), (None, None), (7, "x y z"), (7, "other"), (7, "x y z"), (8, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"item": F.lit(1), "win": F.lit(2), "row": F.lit(3), "maybe": F.lit(True)})
    got = sorted((r.id or 0, r.n_words, r.n_hit, r["items"]) for r in contamination(docs, items).collect())
    assert got == [(0, 0, 0, []), (0, 1, 0, []), (0, 5, 4, ["1"]), (7, 1, 0, []), (7, 3, 3, ["1"]), (7, 3, 3, ["1"]), (8, 3, 0, [])]
    left = clean(docs, items)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, ""), (0, "clean"), (7, "other"), (8, "a b c")]


def test_regular_words_of_items_are_told_apart(spark):
    words = ["".join((x, y)[i.bit_count() & 1] for i in range(1024)) for x, y in (("a", "b"), ("b", "a"))]
    items = spark.createDataFrame(list(enumerate(words)), "item_id bigint, text string")
    docs = spark.createDataFrame([(0, words[0]), (1, "x " + words[1]), (2, " ".join(words))], "doc_id bigint, text string")
    assert sorted((r.id, r.n_hit, r["items"]) for r in contamination(docs, items).collect()) == [(0, 1, ["0"]), (1, 1, ["1"]), (2, 2, ["0", "1"])]


def test_copies_of_a_contaminated_text_and_a_frequent_passage(spark):
    passage = " ".join(f"p{i}" for i in range(14))
    items = spark.createDataFrame([(i, passage + f" end{i}") for i in range(5)], "item_id bigint, text string")
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(passage)).otherwise(F.concat(F.lit("free "), F.col("id"))).alias("text"))
    got = contamination(docs, items).collect()
    assert {(r.n_hit, len(r["items"])) for r in got if r.id % 3 == 0} == {(14, 5)}
    assert all(r.n_hit == 0 for r in got if r.id % 3)
    assert clean(docs, items).count() == 266
