import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomaudit.llm import similar


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similarity(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(texts, least=0.8):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if similarity(sets[a], sets[b]) >= least:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {frozenset(i for i in range(len(texts)) if find(i) == r) for r in {find(i) for i in range(len(texts))}}


def edited(rng, words, least, most):
    """A copy with as many scattered changes as bring the similarity into the range."""
    base, out = shingles(" ".join(words)), list(words)
    while (s := similarity(base, shingles(" ".join(out)))) >= most:
        out[rng.randrange(len(out))] = f"new{rng.random()}"
    return out if s >= least else edited(rng, words, least, most)


def parts(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {}
    for r in similar.near_copies(df, **more).collect():
        out.setdefault(r.component, set()).add(r.id)
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize("least", [0.8, 0.9, 0.95])
def test_recall_of_scattered_edits(spark, least):
    rng, texts = random.Random(int(least * 100)), []
    for _ in range(100):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 300, 1000]))]
        texts += [" ".join(words), " ".join(edited(rng, words, least, least + 0.04))]
    found = parts(spark, texts)
    pairs = {frozenset((i, i + 1)) for i in range(0, 200, 2)}
    assert len(found & pairs) >= (97 if least == 0.8 else 99)
    assert all(len(g) == 1 or g in pairs for g in found)


def test_recall_of_an_inserted_block(spark):
    rng, texts = random.Random(3), []
    for _ in range(100):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        at = rng.randrange(300)
        texts += [" ".join(words), " ".join(words[:at] + [f"n{rng.random()}" for _ in range(24)] + words[at:])]  # similarity 0.91
    assert len(parts(spark, texts) & {frozenset((i, i + 1)) for i in range(0, 200, 2)}) >= 97


@pytest.mark.parametrize("bucket", [32, 3])
def test_components_against_brute_force(spark, bucket):
    rng = random.Random(7)
    texts = [None, "", " \n", "One", "one", "one two", "a b c d e f", "a b c d e g"]
    for _ in range(6):  # chains: neighbours are similar, ends are not
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(60, 90))]
        for _ in range(12):
            texts.append(" ".join(words))
            words = list(words)
            words[rng.randrange(len(words))] = f"v{rng.randrange(400)}"
    found, want = parts(spark, texts, bucket=bucket), brute(texts)
    assert all(any(g <= w for w in want) for g in found)  # no link that is none
    assert len(found) <= len(want) + 2  # of 66 links


def test_a_large_group_of_edits_beside_a_common_passage(spark):
    rng = random.Random(11)
    words = [f"w{rng.randrange(900)}" for _ in range(200)]
    texts = []
    for _ in range(600):  # every two differ in four words: a similarity of 0.81
        copy = list(words)
        for at in rng.sample(range(200), 2):
            copy[at] = f"e{rng.random()}"
        texts.append(" ".join(copy))
    passage = " ".join(words[:60])
    texts += [passage + " " + " ".join(f"z{rng.random()}" for _ in range(90)) for _ in range(200)]
    found = parts(spark, texts)
    assert max(len(g & set(range(600))) for g in found) >= 597
    assert sum(len(g) == 1 and min(g) >= 600 for g in found) == 200


def test_null_ids_repeated_rows_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert similar.near_copies(none).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, text), (None, "other"), (5, text + " more"), (5, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"__row": F.monotonically_increasing_id()} | {c: F.lit("x") for c in ("tag", "t", "class", "id", "print")})
    got = similar.near_copies(df, row_col="__row").collect()
    assert len({r.row for r in got}) == len(got) == 6
    groups = {}
    for r in got:
        groups.setdefault(r.component, []).append(r.id or 0)
    assert sorted(map(sorted, groups.values())) == [[0], [0, 0, 5], [5, 5]]


@pytest.mark.parametrize("bucket", [4, 32])
def test_no_link_of_a_large_group_is_lost(spark, bucket):
    """300 edits of one text, alike to a part of the others only: what meets no first text and no neighbour is found too."""
    rng = random.Random(1)
    words, texts = [f"w{rng.randrange(900)}" for _ in range(120)], []
    for _ in range(300):
        copy = list(words)
        for at in rng.sample(range(120), 2):
            copy[at] = f"e{rng.random()}"
        texts.append(" ".join(copy))
    want = brute(texts)
    assert parts(spark, texts, bucket=bucket) == want and len(want) > 50
