import random

import corpus_pipeline as cp

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def row(i, text, source="s"):
    return (i, text, "en", source, None if text is None else len(text))


def test_copies_of_four_fifths_go(spark):
    rng, rows = random.Random(2), []
    for i in range(0, 60, 2):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        copy = list(words)
        for at in rng.sample(range(400), (2, 4, 8)[i // 2 % 3]):  # similarity about 0.95, 0.9 and 0.8
            copy[at] = f"new{at}"
        rows += [row(i, " ".join(words)), row(i + 1, " ".join(copy))]
    left = cp.near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in left) == list(range(0, 60, 2))


def test_rows_without_ids_or_with_equal_ids_stand_for_themselves(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(50))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [row(None, a), row(None, b), row(None, b), row(7, c), row(7, d), row(8, d), row(None, d), row(9, e, "x"), row(9, e, "y"), row(None, None), row(None, "")]
    left = cp.near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == sorted([(0, a), (0, b), (7, c), (7, d), (9, e), (0, "")])
