import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomaudit.llm import packing
from loomaudit.llm import textscan as ts

FILE = public_tokenizers.path("byte_bpe_50k.json")


def reference(text):
    model = Tokenizer.from_file(FILE)
    model.encode_special_tokens = True
    return model.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library():
    rng = random.Random(3)
    alphabet = ["a", "don", "'", "'s", "'re", "'ll", "l", "ve", "S", " ", "  ", "\n", "\t", " ", "1", "²", "½", "é", "ß", "Ж", "ʼ", "中", "😀", "ᲀ", "!", "$$", "<|endoftext|>", "_", "́", "\x00", "​", " "]
    texts = [None, "", " ", "\n ", "' s", "''s", "a's", "a'sb c", "'s", "\n's", " 's", "a''s"]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(1500)]
    raw, at = ts.text_of(pa.array(texts, pa.string()))
    ids, bounds = packing.Tokens.of(FILE).encode(raw, at)
    model = Tokenizer.from_file(FILE)
    model.encode_special_tokens = True
    for d, t in enumerate(texts):
        assert ids[bounds[d] : bounds[d + 1]].tolist() == model.encode(t or "", add_special_tokens=False).ids, repr(t)


def check(rows, texts, length, ids=True):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for who, own in pieces.items():
        want = reference(texts[who]) + [0]
        own.sort(key=lambda r: r.start)
        at = 0
        for r in own:
            part = np.array(want[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(part))
            assert not ids or bytes(r.ids) == part
            at += r.length
        assert at == len(want)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return len(sequences)


def test_round_trip(spark):
    rng = random.Random(8)
    texts = {0: None, 1: "", 2: "x", 3: "word " * 3000}
    for i in range(4, 150):
        texts[i] = " ".join(rng.choices(["alpha", "béta", "12", "it's", "…"], k=rng.randint(0, 80)))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumns({"id": F.lit(1), "grp": F.lit("z"), "start": F.lit(None)})
    for with_ids in (True, False):
        rows = packing.pack(df.repartition(5), FILE, length=64, windows=3, together=2, with_ids=with_ids).collect()
        used = sum(r.length for r in rows)
        assert check(rows, texts, 64, with_ids) * 64 < used * 1.12
    assert packing.pack(df.limit(0), FILE).count() == 0
    twice = packing.pack(spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id bigint, text string"), FILE).collect()
    assert sum(r.length for r in twice) == 5


def test_best_fit_keeps_few_windows_open():
    rng = random.Random(1)
    fit, done = packing.BestFit(100, 8), []
    for i in range(5000):
        size = rng.randint(1, 99)
        if (out := fit.place(size, (i, size))) is not None:
            done.append(sum(x[2] for x in out[1]))
        assert len(fit.held) <= 8
    assert sum(done) + sum(x[2] for _, p in fit.rest() for x in p) > 0 and sum(done) / len(done) > 92


def test_little_is_held_at_once(spark, monkeypatch):
    """Small batches in both directions, and memory is handed back when a task ends."""
    from loomaudit.llm import common

    real = packing._pack

    def watched(*args):
        def run(batches):
            def few():
                for b in batches:
                    assert b.num_rows <= 1000
                    yield b

            for made in real(*args)(few()):
                assert made.nbytes < 6 << 20
                yield made

        return run

    monkeypatch.setattr(packing, "_pack", watched)
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', 1000)").alias("text")).coalesce(1)
    assert packing.pack(df, FILE).agg(F.sum("length")).first()[0] == 6000 * (len(reference("word " * 1000)) + 1)
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert list(common.lean(lambda batches: batches)(iter([1, 2]))) == [1, 2] and calls == [1]
