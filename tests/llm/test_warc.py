import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomaudit.llm import warc


def brute(rows):
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        again = i is not None and len(raw) >= 100 and first[h or ""] != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [700, 4 << 20])
def test_round_trip(spark, split):
    rng = random.Random(split)
    html = ["é" * 50, "x" * 99, "y" * 100, "", None, "".join(chr(rng.randint(1, 0x7FF)) for _ in range(900)), "WARC/1.1\r\n\r\n" * 20, "\x1f\x08" * 200]
    rows = [(i, rng.choice(html)) for i in range(60)] + [(100, "z" * 300_000), (None, "y" * 100)]
    df = spark.createDataFrame(rows, "page_id bigint, html string").withColumns(
        {"url": F.when(F.col("page_id") % 2 == 0, F.lit("http://a/é\r\nX: y")), "key": F.lit(1), "digest": F.lit("q"), "payload": F.lit(None)}
    )
    manifest = warc.write_warc(df.repartition(3))
    got = warc.read_warc(spark, manifest, split).select(
        warc.key_of("record_id"), "payload_bytes", "payload_digest", "record_type", warc.key_of("refers_to"), "payload", "digest_ok"
    )
    seen = []
    for key, n, digest, kind, refers, payload, ok in got.collect():
        seen.append((None if key == "None" else int(key), n, digest, kind, int(refers) if refers else None))
        if kind == "response":
            assert ok and hashlib.sha256(bytes(payload)).hexdigest() == digest
    assert sorted(seen, key=repr) == brute(rows)


def test_any_tool_reads_the_archives(spark):
    df = spark.createDataFrame([(1, "http://a", "hello")], "page_id bigint, url string, html string")
    path = warc.write_warc(df).first().path
    with gzip.open(path.removeprefix("file://")) as f:
        text = f.read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"\r\n\r\nhello\r\n\r\n")


def test_scan_skips_what_is_no_record(spark, tmp_path):
    good = warc._deflate(warc._record(7, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None), 6)
    other = gzip.compress(b"no record")
    data = b"\x1f\x8b\x08junk" + good + other + good[:40] + good
    (tmp_path / "a.gz").write_bytes(data)
    manifest = spark.createDataFrame([((tmp_path / "a.gz").as_uri(), len(data))], warc.MANIFEST)
    for split in (5, 64, 1 << 20):
        assert [r.record_id for r in warc.read_warc(spark, manifest, split).collect()] == ["urn:record:7"] * 2


def test_empty(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read_warc(spark, warc.write_warc(none)).count() == 0


def test_headers_as_others_write_them(spark, tmp_path):
    record = lambda *lines, body=b"": b"\r\n".join([b"WARC/1.0", *lines]) + b"\r\n\r\n" + body + b"\r\n\r\n"
    one = record(b"WARC-Type:resource", b"warc-record-id:<urn:a>", b"WARC-Target-URI: http://x/", b"\t?q=1", b"Content-Length:3", body=b"abc")
    two = record(b"WARC-Type: metadata", b"WARC-Record-ID: <urn:b>", b"Content-Length: 2", body=b"de")
    odd = record(b"WARC-Type: resource", b"WARC-Record-ID: <urn:c>", b"Content-Length: many", body=b"xyz")
    data = warc._deflate(one + two, 6) + warc._deflate(odd, 6)
    (tmp_path / "b.gz").write_bytes(data)
    manifest = spark.createDataFrame([((tmp_path / "b.gz").as_uri(), len(data))], warc.MANIFEST)
    for split in (7, 1 << 20):
        got = sorted((r.record_id, r.record_type, r.target_uri, bytes(r.payload)[:3]) for r in warc.read_warc(spark, manifest, split).collect())
        assert got == [("urn:a", "resource", "http://x/ ?q=1", b"abc"), ("urn:b", "metadata", None, b"de"), ("urn:c", "resource", None, b"xyz")]


def test_repeated_rows_are_written_each(spark):
    df = spark.createDataFrame([(1, "y" * 200)] * 3 + [(2, "y" * 200)], "page_id bigint, html string").withColumn("url", F.lit(None).cast("string"))
    got = sorted((r.record_id, r.record_type) for r in warc.read_warc(spark, warc.write_warc(df)).collect())
    assert got == [("urn:record:1", "response")] * 3 + [("urn:record:2", "revisit")]
