import numpy as np
import pytest
from pyspark.sql import functions as F

from loomaudit.llm import media


def picture(seed, h=96, w=96):
    return np.random.default_rng(seed).integers(0, 256, (h // 6, w // 6)).astype(np.uint8).repeat(6, 0).repeat(6, 1)


def test_png_and_pnm():
    p = picture(1)
    assert (media.decode(media.encode_png(p)) == p).all()
    assert (media.decode(b"P5\n# c\n96 96\n255\n" + p.tobytes()) == p).all()
    for bad in (None, b"", b"\x89PNG\r\n\x1a\n", media.encode_png(p)[:60], b"P5 1"):
        assert media.decode(bad) is None
    rgb = np.stack([p, p, p], 2)
    head = (96).to_bytes(4, "big") * 2 + bytes([8, 2, 0, 0, 0])
    import zlib

    rows = []
    for y, row in enumerate(rgb.reshape(96, -1).astype(np.int64)):
        kind = y % 5
        up = rgb.reshape(96, -1).astype(np.int64)[y - 1] if y else np.zeros(288, np.int64)
        left, corner = np.concatenate([[0] * 3, row[:-3]]), np.concatenate([[0] * 3, up[:-3]])
        q = left + up - corner
        near = np.where((abs(q - left) <= abs(q - up)) & (abs(q - left) <= abs(q - corner)), left, np.where(abs(q - up) <= abs(q - corner), up, corner))
        guess = [np.zeros(288, np.int64), left, up, (left + up) // 2, near][kind]
        rows.append(bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes())
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert abs(media.decode(data).astype(int) - p).max() <= 1


def resized(p, h, w):
    y, x = np.clip((np.arange(h) + 0.5) * p.shape[0] / h - 0.5, 0, p.shape[0] - 1), np.clip((np.arange(w) + 0.5) * p.shape[1] / w - 0.5, 0, p.shape[1] - 1)
    a, b = np.minimum(y.astype(int), p.shape[0] - 2), np.minimum(x.astype(int), p.shape[1] - 2)
    fy, fx = (y - a)[:, None], (x - b)[None]
    return (p[a][:, b] * (1 - fy) + p[a + 1][:, b] * fy) * (1 - fx) + (p[a][:, b + 1] * (1 - fy) + p[a + 1][:, b + 1] * fy) * fx


def turned(p, degrees):
    a, (h, w) = np.radians(degrees), p.shape
    c, s = np.cos(a), np.sin(a)
    yy, xx = np.mgrid[: int(abs(h * c) + abs(w * s)), : int(abs(w * c) + abs(h * s))]
    y, x = yy - yy.max() / 2, xx - xx.max() / 2
    sx, sy = c * x + s * y + (w - 1) / 2, -s * x + c * y + (h - 1) / 2
    known = (sx >= 0) & (sx < w - 1) & (sy >= 0) & (sy < h - 1)
    sx, sy = np.where(known, sx, 0), np.where(known, sy, 0)
    i, j = sy.astype(int), sx.astype(int)
    fy, fx = sy - i, sx - j
    return np.where(known, p[i, j] * (1 - fy) * (1 - fx) + p[i, j + 1] * (1 - fy) * fx + p[i + 1, j] * fy * (1 - fx) + p[i + 1, j + 1] * fy * fx, 0)


def scene(kind, seed):
    """160 x 160 pixels of smooth noise or of overlapping blocks."""
    rng = np.random.default_rng(seed)
    if kind == "noise":
        p = sum(resized(rng.normal(0, 1, (k, k)), 160, 160) * (200 / k) for k in (5, 10, 20, 40))
        return (p - p.min()) / (p.max() - p.min()) * 255
    p = np.full((160, 160), 30.0)
    for _ in range(40):
        (y, x), (h, w) = rng.integers(0, 150, 2), rng.integers(6, 50, 2)
        p[y : y + h, x : x + w] = rng.integers(0, 255)
    return p


EDITS = {
    "crop": lambda p: p[25:140, 20:150],
    "noise": lambda p: p + np.random.default_rng(0).normal(0, 4, p.shape),
    "brightness": lambda p: p * 0.8 + 25,
    "zoom 0.7": lambda p: resized(p, 112, 112),
    "zoom 0.85": lambda p: resized(p, 136, 136),
    "zoom 1.2": lambda p: resized(p, 192, 192),
    "zoom 1.4": lambda p: resized(p, 224, 224),
    "turn 5": lambda p: turned(p, 5),
    "turn 15": lambda p: turned(p, 15),
    "turn 30": lambda p: turned(p, 30),
    "turn 45": lambda p: turned(p, 45),
    "turn 90": lambda p: np.rot90(p),
    "cover": lambda p: np.where((np.add.outer(np.arange(160), np.zeros(160)) < 50), 128, p),
}


def png(p):
    return media.encode_png(np.clip(np.rint(p), 0, 255))


@pytest.mark.parametrize("kind", ["noise", "blocks"])
def test_recall_by_kind_of_edit(spark, kind):
    """Every original with one edit of each kind; nine of ten at least are found, and no two pictures are mixed up."""
    n, rows = 20, []
    for k in range(n):
        p = scene(kind, k)
        rows += [(1000 * e + k, png(edit(p))) for e, edit in enumerate([lambda p: p, *EDITS.values()])]
    missed = {}
    for e, name in enumerate(EDITS, 1):
        pairs = [r for r in rows if r[0] // 1000 in (0, e)]
        got = {r.id: r.component for r in media.copies(spark.createDataFrame(pairs, "image_id bigint, image binary").repartition(4)).collect()}
        missed[name] = sum(got[1000 * e + k] != k for k in range(n))
        assert all(c % 1000 == i % 1000 for i, c in got.items()), name
    print("MISSED", kind, missed)
    assert max(missed.values()) <= n // 10, missed


def test_one_picture_in_500_edits_beside_others(spark):
    """Crops and covered parts of one picture, more than any bucket holds, lose no link."""
    p, rows = scene("noise", 99), []
    rng = np.random.default_rng(5)
    for i in range(500):
        q = p.copy()
        y, x = rng.integers(0, 120, 2)
        q[y : y + 30, x : x + 30] = rng.integers(0, 255)
        rows.append((i, png(q[rng.integers(0, 20) :, rng.integers(0, 20) :])))
    rows += [(1000 + k, png(scene("noise", k))) for k in range(60)]
    got = {r.id: r.component for r in media.copies(spark.createDataFrame(rows, "image_id bigint, image binary").repartition(4)).collect()}
    assert {got[i] for i in range(500)} == {0}
    assert all(got[1000 + k] == 1000 + k for k in range(60))


def test_defined_cases(spark):
    p = scene("blocks", 3)
    rows = [(1, png(p)), (1, png(p)), (None, png(p)), (7, png(p[10:, 10:])), (900, None), (901, b"no image"), (902, png(np.zeros((50, 50)))), (903, b""), (904, png(p[:10, :10]))]
    df = spark.createDataFrame(rows, "image_id bigint, image binary").withColumns({c: F.lit(1) for c in ("class", "id", "points", "a", "p")})
    got = sorted((r.id or 0, r.component, r.n_descriptors > 0) for r in media.copies(df).collect())
    assert got == [(0, 1, True), (1, 1, True), (1, 1, True), (7, 1, True), (900, 900, False), (901, 901, False), (902, 902, False), (903, 900, False), (904, 904, False)]
    assert media.decode(b"P5 100000 100000 255 " + bytes(10)) is None


def test_highest_and_sums_of_lines_laid_end_to_end():
    rng = np.random.default_rng(2)
    for w, radius in ((21, 2), (47, 8), (64, 16), (64, 25)):
        x = rng.normal(0, 9, (60, w)).astype(np.float32)
        for margin in (0, 10):
            x[:, :margin] = x[:, w - margin :] = -np.inf
            wide = np.pad(x, radius, constant_values=-np.inf)
            want = np.max([wide[i : i + 60, j : j + w] for i in range(2 * radius + 1) for j in range(2 * radius + 1)], 0)
            assert (media._highest(x, radius, margin) == want)[:, margin : w - margin].all()
        x = rng.integers(0, 99, (60, w)).astype(np.float32)
        assert (media._inner(x, 2).reshape(60, w) == media._box(x, 2))[:, 2:-2].all()


def test_every_word_of_a_page_is_drawn():
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(1000)) + "</p>" + " ".join(f"v{i}" for i in range(40))
    one, two = (media.decode(media.draw(*media.ts.text_of(pa.array([t])))[0]) for t in (text, text.replace("w999", "other")))
    assert one.shape == (4 * (63 + 3), 64)
    assert (one != two).any() and ((one != two).any(1).sum() <= 4)


def test_empty_and_pages(spark):
    none = spark.createDataFrame([], "page_id bigint, html string")
    assert media.copies(media.page_images(none)).count() == 0
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a b</p>c\nd " * 40), (3, "x")], "page_id bigint, html string")
    assert media.copies(media.page_images(pages)).count() == 4


def test_a_match_is_one_row_and_an_entry_is_small():
    """What is dealt and written for each match, whose votes in both grids are made afterwards."""
    import pyarrow as pa
    import pyarrow.compute as pc

    found = media.describe([media.decode(png(scene("noise", k))) for k in (1, 1)])
    points = np.zeros(len(found), media._POINT)
    for k, name in enumerate(media._POINT.names, 1):
        points[name] = found[:, k].view(np.uint64) if name == "bits" else found[:, k]
    dealt = pa.Table.from_batches(media._packs(np.array([5, 9]), found[:, 0], points, 6, 5))
    assert sum(len(x) for x in dealt.column("entries").to_pylist()) == 24 * media.BANDS * len(found)
    rows = sum(len(media._matches(5, 32, 24)(seg, dealt.filter(pc.equal(dealt.column("seg"), seg))).column("spot").drop_null()) for seg in dealt.column("seg").to_pylist())
    one, two = (points[found[:, 0] == k] for k in (0, 1))
    differ = one["bits"][:, None] ^ two["bits"][None]
    alike = (np.bitwise_count(differ) <= 5) & np.any([v == 0 for v in media._cut(differ)], 0)
    assert len(one) <= rows <= alike.sum()


def scattered(rng, frequent, places):
    """Points at these places with descriptors that all pictures have, each beside one of its own, so no run of corners repeats."""
    out = np.zeros(2 * len(places), media._POINT)
    out["y"][::2], out["x"][::2], out["bits"][::2] = places[:, 0], places[:, 1], frequent
    out["y"][1::2], out["x"][1::2], out["bits"][1::2] = places[:, 0] + 1, 3, rng.integers(0, 2**63, len(places))
    return out.tobytes()


def test_frequent_descriptors_alone_lose_no_link(spark):
    """Sixty pairs of copies whose eight descriptors are in all 120 pictures; nothing else is shared."""
    rng, n = np.random.default_rng(3), 60
    frequent = rng.integers(0, 2**63, 8).astype(np.uint64)
    places = [np.stack([np.arange(8) * 200 + rng.integers(0, 200, 8), rng.integers(0, 2000, 8)], 1) for _ in range(n)]
    rows = [(k, bytearray(scattered(rng, frequent, places[k]))) for k in range(n)]
    near = frequent ^ np.uint64(1) << np.arange(8, dtype=np.uint64)
    rows += [(n + k, bytearray(scattered(rng, near if k % 2 else frequent, places[k] + [40, 70]))) for k in range(n)]
    df = spark.createDataFrame(rows, "class bigint, points binary").repartition(4)
    for bucket in (4, 32, 1000):
        got = {tuple(sorted((r.a, r.b))) for r in media.links(df, bucket=bucket, whole=True).collect()}
        assert got == {(k, n + k) for k in range(n)}, bucket
    assert media.links(df.filter("class < 3"), whole=True).count() == 0


def repeated(rng, bits, n, wide=400):
    """Points at ``n`` places with descriptors drawn from ``bits``, each beside one of its own."""
    return scattered(rng, rng.choice(bits, n), rng.integers(0, wide, (n, 2)))


def test_textures_that_match_everywhere_are_not_written_match_by_match(spark, tmp_path, monkeypatch):
    """Twelve pictures that repeat one descriptor at 100 places: 660,000 matches are 66 links."""
    monkeypatch.setattr(media.common, "shared_dir", lambda spark: f"file://{tmp_path}")
    rng = np.random.default_rng(8)
    rows = [(k, bytearray(repeated(rng, np.array([12345678901234567], np.uint64), 100))) for k in range(12)]
    df = spark.createDataFrame(rows, "class bigint, points binary").repartition(4)
    assert {(r.a, r.b) for r in media.links(df, whole=True).collect()} == {(a, b) for b in range(12) for a in range(b)}
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 100_000


def test_links_of_whole_buckets_are_those_of_all_pairs(spark):
    """Brute force over all points, by the rule: one transform, five places of the smaller class."""
    rng, n = np.random.default_rng(4), 24
    bits = rng.integers(0, 2**63, 10).astype(np.uint64)
    bits = np.concatenate([bits, bits ^ np.uint64(9) << rng.integers(0, 60, 10).astype(np.uint64)])
    points = [np.frombuffer(repeated(rng, bits, int(k), 160), media._POINT).copy() for k in rng.integers(3, 120, n)]
    for k, p in enumerate(points):
        p["scale"], p["turn"] = rng.integers(0, 2, len(p)), rng.choice([0, 1, 2, 63], len(p))
    df = spark.createDataFrame([(k, bytearray(p.tobytes())) for k, p in enumerate(points)], "class bigint, points binary").repartition(4)
    want = set()
    for p in range(n):
        for q in range(p + 1, n):
            differ = points[p]["bits"][:, None] ^ points[q]["bits"][None]
            i, j = np.nonzero((np.bitwise_count(differ) <= 5) & np.any([v == 0 for v in media._cut(differ)], 0))
            a, b = (np.zeros(len(x), media._ENTRY) for x in (i, j))
            for e, k, x in ((a, p, i), (b, q, j)):
                e["class"], e["place"] = k, points[k]["scale"][x]
                for name in ("y", "x", "turn"):
                    e[name] = points[k][name][x]
            cells = {(g, ds, (dt + 2 * g) // 4 % 16, (hx + g) // 2, (hy + g) // 2, spot) for _, _, ds, dt, hx, hy, spot in media._votes(a, b, 24).tolist() for g in (0, 1)}
            places = [c[:5] for c in cells]
            if any(places.count(c) >= 5 for c in set(places)):
                want.add((p, q))
    assert 20 < len(want) < n * (n - 1) // 2 - 20
    for bucket in (2, 32):
        assert {(r.a, r.b) for r in media.links(df, bucket=bucket, whole=True).collect()} == want


def test_pairs_of_a_large_bucket_are_those_of_other_components():
    rng = np.random.default_rng(6)
    bits = rng.choice(np.array([1, 3, 7, 2**40 + 1, 2**40 - 1, 2**60], np.uint64), 300)
    root = rng.integers(0, 9, 300)
    order = np.lexsort((root, bits))
    bits, root = bits[order], root[order]
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if root[i] != root[j] and int(bits[i] ^ bits[j]).bit_count() <= 5}
    for most in (1, 50, 1 << 18):
        got = [p for a, b in media._crossed(bits, root, 5, most) for p in zip(a.tolist(), b.tolist())]
        assert len(got) == len(set(got)) and {tuple(sorted(p)) for p in got} == want
