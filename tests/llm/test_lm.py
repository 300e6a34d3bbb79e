import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomaudit.llm import lm

END = "\0end"


def lower(c):
    return max((x for x in lm.LEVELS.tolist() if x <= c), default=0)


def upper(c):
    return min(x for x in lm.LEVELS.tolist() if x > c) - 1 if c else 0


def brute(rows, order, extra, weight=0.8):
    """Exact counts, quantised; ``extra`` is the guard of every context."""
    toks = [[*((t or "").encode().lower().split()), END] for _, t in rows]
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    grams = Counter()
    for ws, use in zip(toks, train):
        if use:
            seq = [END, *ws]
            for i in range(1, len(seq)):
                for m in range(1, order + 1):
                    if i - m + 1 >= 0:
                        grams[tuple(seq[i - m + 1 : i + 1])] += 1
    n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
    out = []
    for (i, _), ws, use in zip(rows, toks, train):
        base = score = 0.0
        seq = [END, *ws]
        for at in range(1, len(seq)):
            w = seq[at]
            p = (grams[w,] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            count = grams[w,]
            for m in range(2, order + 1):
                if at - m + 1 < 0:
                    break
                gram = tuple(seq[at - m + 1 : at + 1])
                context = grams[gram[:-1]] if m == 2 else upper(grams[gram[:-1]])
                count = min(lower(grams[gram]), count, context) if count and context else 0
                share = weight * context / (context + 1)
                p = share * count / max(context + extra, 1) + (1 - share) * p
            score += math.log10(p)
        out.append((i, not use, len(ws), sum(grams[w,] > 0 for w in ws), n, base, score))
    return out


@pytest.mark.parametrize("order, group", [(2, 100 << 20), (2, 300), (3, 100 << 20), (4, 2000)])
def test_against_exact_counts(spark, order, group):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(80)] + ["É", "Ab"]
    rows = [(i, " ".join(rng.choices(vocab, weights=range(1, 83), k=rng.randint(0, 60)))) for i in range(120)] + [(200, None), (201, "\n"), (202, "unseen words")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"c": F.lit("x"), "id": F.lit(3), "trained": F.lit(None)})
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    got = {r.id: r for r in lm.score_texts(df.repartition(3), train, order=order, density=40.0, group_bytes=group, per_token=True).collect()}
    guesses = [brute(rows, order, extra) for extra in range(12)]  # the guard is one of these, with so few words
    near = [sum(abs(got[x[0]].score - x[6]) < 1e-6 for x in guess) for guess in guesses]
    for i, held, n, known, total, base, score in guesses[int(np.argmax(near))]:
        r = got[i]
        assert (not r.trained, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-9)
        assert r.score == pytest.approx(score, abs=1e-6)  # at this density a false positive is rare
        assert sum(r.logs) == pytest.approx(r.score, abs=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_the_probabilities_after_a_context_sum_to_one_at_most(spark, order):
    """At the default bits, over a vocabulary of 6,000 words, for frequent and for rare contexts."""
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(6000)]
    rows = [(i, " ".join(rng.choices(vocab, weights=[1 / (k + 1) for k in range(6000)], k=200))) for i in range(150)]
    counts = Counter(w for _, t in rows for w in t.split())
    rare = [w for w, c in counts.items() if c == 1][:20]
    heads = [*(w for w, _ in counts.most_common(4)), *rare]
    if order > 2:
        text = rows[0][1].split()
        heads = [" ".join(text[i : i + 2]) for i in range(0, 40, 2)]
    probes = [(1000 + k, h + " " + w) for k, (h, w) in enumerate((h, w) for h in heads for w in [*counts, "never-seen"])]
    df = spark.createDataFrame(rows + probes, "doc_id bigint, text string").repartition(4)
    got = lm.score_texts(df, F.col("doc_id") < 1000, order=order, per_token=True).filter("id >= 1000").select("id", F.col("logs")[order - 1].alias("p"), F.col("logs")[order].alias("end"))
    mass = Counter()
    for r in got.collect():
        mass[(r.id - 1000) // (len(counts) + 1)] += 10**r.p
    assert len(mass) == len(heads)
    assert 0.5 < min(mass.values()) and max(mass.values()) <= 1.0 + 1e-9


def test_quantised_counts_are_never_too_low_and_false_positives_as_stated():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 63, 30_000).astype(np.uint64) << np.uint64(1))
    counts = rng.geometric(0.3, len(values))
    rows = []
    for seg in range(4):
        own = (values >> np.uint64(62)) == seg
        table = pa.table({"hashes": pa.array([values[own].tobytes()], pa.binary()), "counts": pa.array([counts[own].astype(np.uint32).tobytes()], pa.binary())})
        rows.append(type("R", (), lm._part(2, 2, 1.25)(4 + seg, table).to_pylist()[0]))
    model = lm._load(rows, 2)
    q = lm._quantised(model, values, 2, 2)
    assert (q >= lm.quantise(counts)).all() and (q == lm.quantise(counts)).mean() > 0.97
    other = rng.integers(0, 1 << 63, 1_000_000).astype(np.uint64) << np.uint64(1) | np.uint64(1)
    rate = (lm._quantised(model, other, 2, 2) > 0).mean()
    assert rate < 1.5 * sum(r.passed for r in rows) / 4 + 2e-5 < 2e-3


def test_guard_is_a_quantile():
    for mean in (0.0, 1e-4, 0.3, 5.0):
        b = int(lm.guard(mean))
        below = sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(b + 1))
        assert 1 - below <= 1.1e-6


def test_empty_null_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm.score_texts(none, F.lit(True)).count() == 0
    r = lm.score_texts(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), F.lit(False)).first()
    assert (r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, 0.0)
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id bigint, text string")
    got = lm.score_texts(rows, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1).collect()
    assert len(got) == 3 and {r.train_tokens for r in got} == {9} and all(r.trained for r in got)


def test_scoring_works_on_little_text_at_once():
    """Besides the model a task holds some megabytes, however large its batches are."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from loomaudit.llm import lm

    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 3000, 500)) for _ in range(1500)]
    nothing = pa.nulls(len(texts), pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([True] * len(texts)), pa.array(texts), nothing, nothing], ["id", "trained", "t", "c", "q"])
    packed = pa.Table.from_batches(list(lm._count(1, 2)(iter([batch]))))
    where = np.array(packed.column("seg"))
    made = [lm._part(1, 3, 1.25)(seg, packed.filter(pa.array(where == seg))).to_pylist()[0] for seg in range(4)]
    sent = SimpleNamespace(value=lm._load([SimpleNamespace(**r) for r in made], 1))
    tracemalloc.start()
    rows = sum(b.num_rows for b in lm._score(sent, 1, 3, 2, 0.8, 750_000, 3001, 1e-6, False)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and most < 14 << 20
