import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomaudit.llm import simhash


def brute_fp(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    out = 0
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    for b in range(64):
        if sum(h >> b & 1 for h in hashes) * 2 > len(hashes):
            out |= 1 << b
    return out


def brute_components(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(rows, 2):
        if (x ^ y).bit_count() <= 2:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i, _ in rows}


def test_golay_shares_a_key_within_two_bits():
    golay = simhash.Golay()
    rng = np.random.default_rng(3)
    for flips in (0, 1, 2):
        x = rng.integers(0, 1 << 23, 300)
        y = x.copy()
        for _ in range(flips):
            y ^= 1 << rng.integers(0, 23, 300)
        rows, keys = golay.keys(x)
        rows2, keys2 = golay.keys(y)
        for i in range(300):
            assert set(keys[rows == i]) & set(keys2[rows2 == i])
        assert set(np.bincount(rows)) <= {1, 6}


@pytest.mark.parametrize("bucket", [64, 2])
def test_links_match_brute_force(spark, bucket):
    rng = random.Random(bucket)
    fps = [0]
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(8):
            base ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            fps.append(base)
    rows = [(i, f) for i, f in enumerate(dict.fromkeys(fps))]
    signed = [(int(np.uint64(f).astype(np.int64)),) for _, f in rows]
    from loomaudit.llm.common import components

    found = components(simhash.links(spark.createDataFrame(signed, "fp bigint"), bucket=bucket))
    root = {r.node: r.root for r in found.collect()}
    want = brute_components(rows)
    groups = lambda label: {frozenset(k for k, _ in g) for _, g in itertools.groupby(sorted(label.items(), key=lambda x: x[1]), key=lambda x: x[1])}
    got = {i: root.get(signed[i][0], signed[i][0]) for i, _ in rows}
    assert groups(got) == groups(want)


def test_texts_of_every_kind(spark):
    rng = random.Random(5)
    words = ["The", "é", "fox", "a", "%%", "Zürich", "longer-than-thirty-two-bytes-for-the-wide-lanes"]
    texts = [None, "", " \n", "one", "ONE", "one two", "x" * 70_000, "a " * 70_000]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    texts += texts[-3:]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"fp": F.lit("x"), "id": F.lit(1), "key": F.lit(None)})
    want = [(i, brute_fp(t)) for i, t in rows]
    parts = brute_components(want)
    got = {r.id: (r.fp & (1 << 64) - 1, r.component) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (f, parts[i]) for i, f in want}


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(none).count() == 0
    twice = spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (None, "a b c d")], "doc_id bigint, text string")
    assert [(r.id, r.component) for r in simhash.near_duplicates(twice).orderBy("id").collect()] == [(None, 7), (7, 7), (7, 7)]
