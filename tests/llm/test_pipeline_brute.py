"""Each stage against brute force on its predecessor's rows, and the defined cases of all stages."""

import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from loomaudit.llm import common, queries

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import test_decontam  # noqa: E402
import test_similar  # noqa: E402
import test_substring  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(1500)]
    passages, items = [rng.choices(words, k=rng.randint(50, 80)) for _ in range(5)], [rng.choices(words, k=rng.randint(4, 16)) for _ in range(6)]
    rows, labels = [], []
    for i in range(220):
        w, toxic = rng.choices(words, k=rng.randint(60, 160)), i % 8 == 0
        if i % 11 == 3:
            w += rng.choice(passages)
        if i % 13 == 5:
            at = rng.randrange(len(w))
            w = w[:at] + rng.choice(items) + w[at:]
        if toxic:
            w[rng.randrange(len(w))] = "scum"
        rows.append((i, w))
        labels.append((i, 1, int(toxic)))
    for i in range(220, 260):  # copies, exact and with a few words changed
        w = list(rows[rng.randrange(200)][1])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, w))
    path = str(tmp_path_factory.mktemp("brute"))
    text = [(i, " ".join(w), "en", "s", len(" ".join(w))) for i, w in rows] + [(900, None, None, None, None), (901, "", "en", "s", 0)]
    spark.createDataFrame(text, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, folder), "test")
        common.written(spark).pop()
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    first = sorted(kept["quality"].items())
    assert not [i for i, t in first if "scum" in (t or "").split()]
    groups = test_similar.brute([t for _, t in first])
    assert set(kept["near_copies"]) == {first[min(g)][0] for g in groups}
    whole = test_substring.brute(sorted(kept["near_copies"].items()), 20)
    assert {i: t for i, t in kept["repeats"].items()} == {i: whole[i][2] if whole[i][1] else t for i, t in kept["near_copies"].items()}
    met = test_decontam.brute(list(kept["repeats"].items()), items, 10)
    assert set(kept["decontaminate"]) == {i for i, (_, hit, _) in met.items() if not hit}

    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(queries._vocabulary())
    ids: dict[int, list] = {}
    for r in cp.run(spark, folder).collect():
        ids.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    want = {i: [*tokens.encode(t or "", add_special_tokens=False).ids, 0] for i, t in kept["decontaminate"].items()}
    assert {i: [x for _, part in sorted(parts) for x in part] for i, parts in ids.items()} == want


def test_defined_cases_of_all_stages(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    rng = random.Random(1)
    text = lambda: " ".join(rng.choices([f"z{i}" for i in range(4000)], k=40))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, b), (None, c), (5, d), (5, e), (6, None), (7, "")]
    full = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    clash = {x: F.lit("x") for x in ("id", "t", "th", "row", "tag", "class", "maybe", "quality", "toxic", "spans", "kept", "ids")}
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, none, folder).count() == 0, name
        got = stage(spark, full.withColumns(clash), folder)
        assert got.columns == list(cp.COLUMNS), name
        found = sorted((r.doc_id or 0, r.text or "") for r in got.collect())
        assert [x for x in found if x[1]] == sorted([(0, a), (0, b), (0, c), (5, d), (5, e)]), name
    assert cp.packing(spark, none, folder).count() == 0
    packed = cp.packing(spark, full.withColumns(clash), folder).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in packed} == {None, 5, 6, 7} and {r.doc_id: r.n for r in packed}[6] == 1
