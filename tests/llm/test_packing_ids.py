import zlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from loomaudit.llm import packing, queries


def test_texts_can_be_rebuilt_from_the_pipeline(spark):
    texts = {i: f"it's text {i} " * (i * 60) for i in range(1, 12)}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    pieces = defaultdict(list)
    for r in cp.packing(spark, df, "").collect():
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length * 4 == len(r.ids)
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in texts.items():
        raw = b"".join(x for _, x in sorted(pieces[i]))
        ids = [int.from_bytes(raw[k : k + 4], "little") for k in range(0, len(raw), 4)]
        assert ids[-1] == 0 and model.decode(ids[:-1]) == t


def test_query_takes_its_checksums_from_the_ids(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "some words"), (2, "more words " * 2000), (3, None)], "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = {(r.id, r.start): zlib.crc32(r.ids) for r in packing.pack(df, queries._vocabulary()).collect()}
    made, inner = [], packing.pack
    monkeypatch.setattr(packing, "pack", lambda *a, **b: made.append(inner(*a, **b)) or made[-1])
    got = queries.op5_packing(spark, str(tmp_path))
    assert "ids" not in got.columns and {(r.doc_id, r.start): r.ids_crc32 for r in got.collect()} == want
    assert made[0].filter("ids is null").count() == 0
