import random

import pytest

import corpus_pipeline as cp
from loomaudit.llm import common


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: rng.choices(words, k=n)
    item, passage = text(14), text(60)
    rows, labels = [], []
    for i in range(260):
        w, toxic = text(rng.randint(30, 90)), int(i % 9 == 0)
        if toxic:
            w[rng.randrange(len(w))] = "idiot"
        rows.append([i, w])
        labels.append((i, 1, toxic))
    rows += [[300, list(rows[1][1])], [301, text(40) + item + text(40)], [302, text(40) + passage + text(30)], [303, text(50) + passage + text(20)]]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, " ".join(w), "en", "s", len(" ".join(w))) for i, w in rows]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {i: " ".join(w) for i, w in rows}, " ".join(passage)


def test_stages(spark, tables):
    folder, texts, passage = tables
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in cp.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, folder), "test")
        common.written(spark).pop()
        assert docs.columns == list(cp.COLUMNS)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    toxic = {i for i in range(260) if i % 9 == 0}
    assert set(seen["quality"]) == set(texts) - toxic
    assert set(seen["near_copies"]) == set(seen["quality"]) - {300}
    assert seen["repeats"][302] == texts[302] and passage not in seen["repeats"][303]
    assert seen["repeats"][303] == texts[303].replace(passage + " ", "")
    assert set(seen["decontaminate"]) == set(seen["near_copies"]) - {301}
    packed = cp.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == set(seen["decontaminate"])
