import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomaudit.llm import substring
from loomaudit.llm.substring import remove_repeats


def brute(rows, k):
    first, out = {}, {}
    words = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(words):
        for j in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][j : j + k]), (i, j))
    for i, ws in words.items():
        gone = set()
        for j in range(len(ws) - k + 1):
            if first[tuple(ws[j : j + k])] != (i, j):
                gone.update(range(j, j + k))
        out[i] = (len(ws), len(gone), b" ".join(w for j, w in enumerate(ws) if j not in gone).decode(), gone)
    return out


def check(spark, rows, k=20, m=6):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"id": F.lit("x"), "t": F.lit(None), "mini": F.lit(3)})
    got = remove_repeats(df.repartition(3), k, m).collect()
    want = brute(rows, k)
    assert len(got) == len(rows)
    for r in got:
        n, removed, kept, gone = want[r.id]
        assert (r.n_words, r.n_removed, r.kept) == (n, removed, kept), r.id
        assert {j for s in r.spans for j in range(s.start, s.end)} == gone


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(400)] + ["é", "ß%"]
    passages = [rng.choices(vocab, k=rng.randint(19, 60)) for _ in range(8)]
    texts = [None, "", "  \n", "one two", "go " * 300, "a b " * 50, "x y z " * 7, "go " * 20]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(passages)[rng.randint(0, 6) :] if rng.random() < 0.5 else rng.choices(vocab, k=rng.randint(1, 50))
        texts.append(rng.choice([" ", "\n", " \t"]).join(parts))
    for t in texts[10:20]:
        w = t.split()
        if w:
            w[len(w) // 2] = "edited"
        texts.append(" ".join(w))
    texts += texts[20:24]
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_small_windows_and_letters(spark):
    rng = random.Random(4)
    check(spark, [(i, " ".join(rng.choices("ab", k=rng.randint(0, 40)))) for i in range(25)], k=5, m=2)


def test_empty_and_repeated_ids(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert remove_repeats(none).count() == 0
    long = " ".join(f"u{i}" for i in range(25))
    rows = spark.createDataFrame([(1, long), (1, long), (None, "z " + long), (2, long)], "doc_id bigint, text string")
    got = sorted((r.id or 0, r.n_removed) for r in remove_repeats(rows).collect())
    assert got == [(0, 0), (1, 25), (1, 25), (2, 25)]


def test_rebuilding_in_several_chunks():
    texts = ["a b c " * 400_000, "d " * 30, "e f " * 900_000, "g " * 30]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("width", pa.int32()), ("digest", pa.binary())]))
    proof = lambda d, lo: hashlib.blake2b(" ".join(texts[d].split()[lo : lo + 20]).encode(), digest_size=16).digest()
    windows = [[(0, lo) for lo in (0,)], [], [(2, lo) for lo in (1, 2)], [(3, lo) for lo in (0,)]]
    windows = [[{"start": lo, "width": 20, "digest": proof(d, lo)} for d, lo in x] or None for x in windows]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts), pa.array(windows, kind)], ["id", "t", "windows"])
    out = pa.Table.from_batches(list(substring._finish()([batch])))
    out.validate(full=True)
    assert out.num_rows == 4 and out.column("n_removed").to_pylist() == [20, 0, 21, 20]
    assert out.column("kept").to_pylist()[3] == " ".join(["g"] * 10)
    assert out.column("spans").to_pylist()[2] == [{"start": 1, "end": 22}]


def _thue_morse(n, a, b):
    return [(a, b)[i.bit_count() & 1] for i in range(n)]


def test_regular_orders_of_words_and_letters_do_not_collide(spark):
    texts = [" ".join(_thue_morse(1024, *x)) for x in (("ha", "ho"), ("ho", "ha"))]
    texts += ["".join(_thue_morse(1024, *x)) + " " + " ".join(f"q{i}" for i in range(29)) for x in (("a", "b"), ("b", "a"))]
    texts += [" ".join(_thue_morse(32, *x)) for x in (("c", "d"), ("d", "c"))]
    check(spark, list(enumerate(texts)))


def test_ids_that_are_null_or_repeat(spark):
    rng = random.Random(9)
    rows = [(None if i % 3 else 7, " ".join(rng.choices([f"v{j}" for j in range(500)], k=30))) for i in range(60)]
    shared = " ".join(f"s{j}" for j in range(25))
    rows += [(None, "first " + shared), (7, "second " + shared), (None, None), (None, "")]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    assert sorted((r.id or 0, r.n_removed) for r in got if r.n_removed) == [(7, 25)]


def test_clashing_columns_and_repeated_rows(spark):
    long = " ".join(f"u{i}" for i in range(40))
    df = spark.createDataFrame([(1, long)] * 30 + [(2, long)] * 30, "doc_id bigint, text string")
    df = df.withColumns({c: F.lit("x") for c in ("id", "th", "t", "at", "windows", "first", "row", "digest", "sid")})
    got = remove_repeats(df, carry=("row", "sid")).collect()
    assert sorted((r.id, r.n_removed, r.row.sid) for r in got) == [(1, 0, "x")] * 30 + [(2, 40, "x")] * 30


def test_equal_hashes_of_different_spans_are_noticed(spark):
    words = " ".join(f"u{i}" for i in range(25))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("width", pa.int32()), ("digest", pa.binary())]))
    windows = pa.array([[{"start": 0, "width": 20, "digest": b"0" * 16}]], kind)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([words]), windows], ["id", "t", "windows"])
    try:
        list(substring._finish()([batch]))
    except substring.Collision:
        return
    raise AssertionError("a wrong digest must raise")


def test_spans_merge_by_source_and_distance():
    window = lambda at, sat, sid=5: {"at": at, "width": 20, "sid": sid, "sth": 0, "sat": sat}
    rows = [{"id": 1, "th": 0, "windows": [window(3, 10), window(4, 11), window(30, 37), window(5, 99), window(6, 13, None)]}, {"id": 2, "th": 0, "windows": [window(3, 10)]}]
    kind = pa.list_(pa.struct([("at", pa.int32()), ("width", pa.int32()), ("sid", pa.int64()), ("sth", pa.int64()), ("sat", pa.int32())]))
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("windows", kind)])
    got = pa.Table.from_batches(list(substring._merge()([pa.RecordBatch.from_pylist(rows, schema)]))).to_pylist()
    found = sorted((r["id"], r["at"], r["width"], r["sid"] or 0, r["sat"]) for r in got)
    assert found == [(1, 3, 21, 5, 10), (1, 5, 20, 5, 99), (1, 6, 20, 0, 13), (1, 30, 20, 5, 37), (2, 3, 20, 5, 10)]
    assert np.all([r["th"] == 0 for r in got])
