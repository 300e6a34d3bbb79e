"""Copies of images found by local descriptors.

Per image: a pyramid of ``scales`` scales, each 2 ** (1/3) times smaller than the one
before; corners by the Harris response, the strongest within ``apart`` pixels of its scale;
an orientation from the intensity centroid of the patch, in ``TURNS`` steps; and a
descriptor of 64 comparisons of smoothed patch points, turned by that orientation.  Images
of a run are laid below each other, so numpy works on all of them at once.

Across images: images with equal bytes are one class (by a 64-bit hash).  A descriptor is
cut into three bands; descriptors at most two bits apart agree in one band at least, and
those up to ``distance`` bits apart mostly do, so Hamming tables keyed by (band, value)
hold the candidates.  Entries of a bucket are paired and verified bit by bit, matches vote
for a transform (steps of scale and turn, and where the other image's origin lies), and a
pair of classes is linked if one transform gathers ``votes`` matches from different places.
Components of the links are the copies.

Large groups: ``votes`` corners that follow each other line by line, with equal descriptors
and equal offsets, agree on a transform by themselves.  Their joint hash is a key of its
own, and all classes that share it are joined through the smallest, so hundreds of edits of
one picture cost linear work and need no bucket.  Runs are reduced by the task that made them
before anything is dealt by key.  Those components are found first, and buckets then pair
entries of different components.

In buckets of more than ``bucket`` entries (common ornaments, many copies) each entry meets
the first one and its neighbour in order of the bits, by default; two images that share no
run of unchanged corners and only descriptors that are frequent then stay apart.  With
``whole`` all entries of different components are paired in buckets of any size, so the
components are those of all pairs.  Equal descriptors of one class are one group, however
often a texture repeats them, and groups are paired.  Pairs of classes are counted first, by
hash, with the places that each match can add; only those that may reach ``votes`` are looked
at again, place by place.  What agrees within one segment is a link at once, other matches
are dealt by pair and counted.  Entries are dealt once for both passes.  Work and counts
grow with the square of the number of classes that have like descriptors; an ornament that
is in many pictures which are no copies of each other costs that.  More pairs also mean more that gather ``votes`` by
chance: of 30,000 pairs of an edit of one picture of noise and another picture 182 do (4
scales, 8 pixels apart), which mixes up most of them; raise ``votes`` where that matters.

Recall by kind of edit (pictures of blocks and of noise, 160 x 160 pixels, as tested): crop,
noise, brightness, zoom 0.7 to 1.4 and turns by any angle, 0.9 or more each.

Defined cases: a null or undecodable image has no descriptors and is a class of its own
unless the bytes are equal; so does one of more than ``MOST_PIXELS`` pixels, which would
not fit a task, or smaller than a patch; images without corners match equal bytes only;
repeated rows are in one class; a null id never names a class unless all its ids are null;
equal responses are corners each; at most 64 scales, and images at most 65,535 pixels wide (wider: undecodable); an empty table gives an empty result; other columns are
ignored, whatever their names.  PNG with eight bits a channel, not interlaced and without
palette, and binary PGM and PPM can be decoded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, segments
from . import textscan as ts

STEP = 2 ** (1 / 3)
PATCH = 9  # radius of a patch
TURNS = 64
BANDS = 3
MOST_PIXELS = 1 << 25


def encode_png(pixels: np.ndarray) -> bytes:
    """An 8-bit grey PNG."""
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    h, w = pixels.shape
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.astype(np.uint8)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey pixels of an 8-bit PNG (grey, RGB, with or without alpha) or binary PGM or PPM."""
    try:
        if data is None:
            return None
        if data[:2] in (b"P5", b"P6"):
            fields, at = [], 2
            while len(fields) < 3:
                while data[at : at + 1].isspace():
                    at += 1
                if data[at : at + 1] == b"#":
                    at = data.index(b"\n", at)
                    continue
                end = at
                while end < len(data) and not data[end : end + 1].isspace():
                    end += 1
                fields.append(int(data[at:end]))
                at = end
            w, h, most = fields
            if w * h > MOST_PIXELS or w > 0xFFFF:
                return None
            planes = 1 if data[:2] == b"P5" else 3
            pixels = np.frombuffer(data, np.uint8, w * h * planes, at + 1).reshape(h, w, planes)
            return _grey(pixels) if most == 255 else None
        if data[:8] != b"\x89PNG\r\n\x1a\n":
            return None
        at, packed, planes = 8, [], 0
        while at < len(data):
            size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
            body = data[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                w, h = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
                planes = {0: 1, 2: 3, 4: 2, 6: 4}.get(body[9], 0)
                if body[8] != 8 or not planes or body[12] or w * h > MOST_PIXELS or w > 0xFFFF:
                    return None
            elif kind == b"IDAT":
                packed.append(body)
            at += size + 12
        lines = np.frombuffer(zlib.decompressobj().decompress(b"".join(packed), h * (w * planes + 1)), np.uint8).reshape(h, w * planes + 1)
        return _grey(_unfilter(lines, planes).reshape(h, w, planes))
    except (ValueError, IndexError, zlib.error, UnboundLocalError):
        return None


def _unfilter(lines: np.ndarray, planes: int) -> np.ndarray:
    out = np.zeros((len(lines), lines.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, line in enumerate(lines):
        kind, row = line[0], line[1:]
        if kind == 1:
            row = np.cumsum(row.reshape(-1, planes), 0, dtype=np.uint8).ravel()
        elif kind == 2:
            row = row + above
        elif kind > 2:  # each byte depends on the one before
            row, over = bytearray(row), bytes(above)
            for x in range(len(row)):
                a, b = row[x - planes] if x >= planes else 0, over[x]
                c = over[x - planes] if x >= planes else 0
                if kind == 4:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    near = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                else:
                    near = (a + b) // 2
                row[x] = (row[x] + near) & 255
            row = np.frombuffer(bytes(row), np.uint8)
        out[y] = above = row
    return out


def _grey(pixels: np.ndarray) -> np.ndarray:
    planes = pixels.shape[2]
    if planes < 3:
        return pixels[:, :, 0].copy()
    return (pixels[:, :, 0] * 0.299 + pixels[:, :, 1] * 0.587 + pixels[:, :, 2] * 0.114).astype(np.uint8)


def _tests() -> np.ndarray:
    """64 pairs of patch points, far enough from each other, for each turn, from a fixed rule."""
    draws = (ts.mix(np.arange(1, 4 * 4000 + 1, dtype=ts.U)) >> ts.U(11)).astype(np.float64) / 2**53
    points = (draws.reshape(-1, 2, 2) * 2 - 1) * PATCH
    inside = (np.hypot(points[:, :, 0], points[:, :, 1]) <= PATCH).all(1)
    apart = np.hypot(*(points[:, 0] - points[:, 1]).T) > 0.6 * PATCH
    points, out = points[inside & apart][:64], []
    for k in range(TURNS):
        a = 2 * np.pi * k / TURNS
        out.append(np.rint(points @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])).astype(np.int64))
    return np.array(out)


_TESTS = _tests()
_yy, _xx = np.mgrid[-PATCH : PATCH + 1, -PATCH : PATCH + 1]
_DISC = (_yy**2 + _xx**2) <= PATCH**2
_WEIGHTS = np.stack([(_yy * _DISC).ravel(), (_xx * _DISC).ravel()], 1).astype(np.float32)


def _box(x: np.ndarray, radius: int) -> np.ndarray:
    """Sums over squares; what lies beyond the borders is not used by anyone."""
    out = x.copy()
    for d in range(1, radius + 1):
        out[d:] += x[:-d]
        out[:-d] += x[d:]
    x, out = out, out.copy()
    for d in range(1, radius + 1):
        out[:, d:] += x[:, :-d]
        out[:, :-d] += x[:, d:]
    return out


def _inner(x: np.ndarray, radius: int) -> np.ndarray:
    """As :func:`_box`, with rows end to end, which is faster; the outer columns take in the neighbouring rows."""
    for step in (x.shape[1], 1):
        x, out = x.ravel(), x.ravel().copy()
        for d in range(step, radius * step + 1, step):
            out[d:] += x[:-d]
            out[:-d] += x[d:]
        x = out.reshape(-1, step) if step > 1 else out
    return x


def _highest(x: np.ndarray, radius: int, margin: int = 0) -> np.ndarray:
    """The maximum of each square, at ``margin`` or more columns from the borders; columns nearer to them are all minus infinity."""
    (h, w), gap = x.shape, max(0, radius - 2 * margin)  # rows lie end to end, two margins and the gap apart
    p, width = np.pad(x, ((0, 0), (0, gap)), constant_values=-np.inf).ravel() if gap else x.ravel(), 2 * radius + 1
    for step in (1, w + gap):
        n, size = len(p), 1
        p = np.pad(p, radius * step, constant_values=-np.inf)
        while size * 2 <= width:
            p, size = np.maximum(p[: -size * step], p[size * step :]), size * 2
        last = (width - size) * step
        p = np.maximum(p[:n], p[last : last + n])
    return p.reshape(h, w + gap)[:, :w]


def _resized(strip: np.ndarray, heights: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """A strip of images, each smaller by the scale, by linear interpolation."""
    if not scale:
        return strip, heights
    f, w = STEP**-scale, strip.shape[1]
    smaller, width = np.maximum(np.rint(heights * f).astype(np.int64), 1), max(1, round(w * f))
    first, start = np.cumsum(heights) - heights, np.cumsum(smaller) - smaller
    at = np.arange(int(smaller.sum())) - np.repeat(start, smaller)
    ratio, base, last = (np.repeat(v, smaller) for v in (heights / smaller, first, heights - 1))
    y = np.clip((at + 0.5) * ratio - 0.5, 0, last)
    low = y.astype(np.int64)
    part = (y - low).astype(np.float32)[:, None]
    rows = strip[base + low] * (1 - part) + strip[base + np.minimum(low + 1, last)] * part
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    low = x.astype(np.int64)
    part = (x - low).astype(np.float32)
    return rows[:, low] * (1 - part) + rows[:, np.minimum(low + 1, w - 1)] * part, smaller


_FIELDS = ("image", "y", "x", "scale", "turn", "bits")


def describe(images: list[np.ndarray | None], scales: int = 4, apart: int = 8, most: int = 1 << 16) -> np.ndarray:
    """Rows ``image, y, x, scale, turn, bits``, places in pixels of the first scale, by image, scale and place."""
    out = [np.zeros((0, 6), np.int64)]
    known = [i for i, p in enumerate(images) if p is not None and min(p.shape) >= 2 * PATCH + 3]
    known.sort(key=lambda i: images[i].shape[1])
    lo = 0
    while lo < len(known):
        hi, size, width = lo, 0, images[known[lo]].shape[1]
        while hi < len(known) and images[known[hi]].shape[1] == width and (hi == lo or size < most):
            size += images[known[hi]].size
            hi += 1
        group = known[lo:hi]
        strip = np.concatenate([images[i] for i in group]).astype(np.float32)
        heights = np.array([images[i].shape[0] for i in group])
        for scale in range(scales):
            found = _corners(*_resized(strip, heights, scale), apart)
            found[:, 0] = np.array(group)[found[:, 0]]
            found[:, 1:3] = np.rint(found[:, 1:3] * STEP**scale)
            out.append(np.insert(found, 3, scale, axis=1))
        lo = hi
    rows = np.concatenate(out)
    return rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 3], rows[:, 0]))]


def _corners(strip: np.ndarray, heights: np.ndarray, apart: int) -> np.ndarray:
    """Rows ``image, y, x, turn, bits`` of one scale of a strip."""
    w = strip.shape[1]
    if w < 2 * PATCH + 3:
        return np.zeros((0, 5), np.int64)
    calm = _inner(strip, 1) / np.float32(9)
    gy, gx = np.zeros((2, calm.size), np.float32)
    for slope, step in ((gy, w), (gx, 1)):
        slope[step:-step] = (calm[2 * step :] - calm[: -2 * step]) / np.float32(2)
    xx, yy, xy = (_inner(v.reshape(-1, w), 2).reshape(-1, w) for v in (gx * gx, gy * gy, gx * gy))
    response = xx * yy - xy * xy - np.float32(0.05) * (xx + yy) ** 2
    start = np.cumsum(heights) - heights
    row = np.arange(len(strip)) - np.repeat(start, heights)
    inside = (row > PATCH) & (row < np.repeat(heights, heights) - PATCH - 1)
    response[~inside] = -np.inf
    response[:, : PATCH + 1] = response[:, w - PATCH - 1 :] = -np.inf
    y, x = np.divmod(np.flatnonzero((response > 1e3) & (response == _highest(response, apart, PATCH + 1))), w)
    if not len(y):
        return np.zeros((0, 5), np.int64)
    patch = strip[y[:, None, None] + _yy, x[:, None, None] + _xx].reshape(len(y), -1)
    centre = patch @ _WEIGHTS
    turn = np.rint(np.arctan2(centre[:, 0], centre[:, 1]) / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
    flat, points = _box(strip, 2), _TESTS[turn]
    value = flat[y[:, None, None] + points[:, :, :, 1], x[:, None, None] + points[:, :, :, 0]]
    bits = ((value[:, :, 0] > value[:, :, 1]).astype(ts.U) << np.arange(64, dtype=ts.U)).sum(1, dtype=ts.U)
    image = np.repeat(np.arange(len(heights)), heights)[y]
    return np.stack([image, y - start[image], x, turn, bits.view(np.int64)], 1)


_POINT = np.dtype([("y", "<u4"), ("x", "<u2"), ("scale", "u1"), ("turn", "u1"), ("bits", "<u8")])
_ENTRY = np.dtype([("class", "<i8"), ("y", "<u4"), ("x", "<u2"), ("place", "u1"), ("turn", "u1"), ("bits", "<u8")])  # place: scale and band
_LINK = np.dtype([("key", "<u8"), ("class", "<i8")])
_PAIR = np.dtype([("a", "<i8"), ("b", "<i8")])
_VOTE = np.dtype([("p", "<i8"), ("q", "<i8"), ("ds", "<i8"), ("dt", "<i8"), ("hx", "<i8"), ("hy", "<i8"), ("spot", "<i8")])
_PACKED = "seg int, entries binary, roots binary"
_JOINT = "seg int, runs binary, pairs binary"
_AGREED = "seg int, classes binary, votes binary, pairs binary"


def _shrunk(rows: np.ndarray) -> bytes:
    """Rows byte by byte of all, compressed; the first eight bytes say how many they are."""
    planes = np.ascontiguousarray(np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), rows.itemsize).T)
    return len(rows).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _grown(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    """The rows of several of :func:`_shrunk`."""
    rows = [np.zeros(0, kind)]
    for blob in blobs:
        if n := int.from_bytes(blob[:8], "little"):
            planes = pa.decompress(blob[8:], n * kind.itemsize, codec="zstd")
            rows.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(-1, n).T).view(kind).ravel())
    return np.concatenate(rows)


def _cut(bits: np.ndarray) -> list[np.ndarray]:
    """The bands of each descriptor."""
    edges = [64 * k // BANDS for k in range(BANDS + 1)]
    return [bits >> ts.U(lo) & ts.U((1 << hi - lo) - 1) for lo, hi in zip(edges[:-1], edges[1:])]


def _band_key(value: np.ndarray, k: int) -> np.ndarray:
    return ts.mix(value << ts.U(2) | ts.U(k))


def _star(links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For entries of one key: each class with the smallest, and the smallest of each key."""
    links = np.unique(links)  # by key, then class
    new = np.ones(len(links), bool)
    new[1:] = links["key"][1:] != links["key"][:-1]
    low = links[new][np.cumsum(new) - 1]
    return low["class"][~new], links["class"][~new], links[new]


def _entries(klass: np.ndarray, found: np.ndarray, root: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Entries of all bands, and components of classes that are not their own, each with their keys."""
    own, n = found["bits"], len(found)
    entries, hashes = np.zeros(n * BANDS, _ENTRY), []
    for k, value in enumerate(_cut(own)):
        part = entries[k * n : (k + 1) * n]
        part["class"], part["place"] = klass, found["scale"] | k << 6
        for name in ("y", "x", "turn", "bits"):
            part[name] = found[name]
        hashes.append(_band_key(value, k))
    key = np.concatenate(hashes)
    kin = np.flatnonzero(np.tile(root != klass, BANDS))
    roots = np.zeros(len(kin), _PAIR)
    roots["a"], roots["b"] = entries["class"][kin], np.tile(root, BANDS)[kin]
    return [entries, roots], [key, key[kin]]


def _runs(klass: np.ndarray, image: np.ndarray, found: np.ndarray, votes: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Joint keys of neighbouring corners, and classes paired already, each with their keys."""
    own, n = found["bits"], len(found)
    # corners that follow each other in one image and scale
    m = max(0, n - votes + 1)
    same = (image[:m] == image[n - m :]) & (found["scale"][:m] == found["scale"][n - m :])
    joint = ts.mix(own[:m])
    for d in range(1, votes):
        dy, dx = (found[c][d : m + d].astype(np.int64) - found[c][:m] for c in ("y", "x"))
        joint = ts.mix(joint ^ ts.mix(own[d : m + d]) + ts.mix((dy << 32 | dx & 0xFFFFFFFF).view(ts.U)))
    runs = np.zeros(int(same.sum()), _LINK)
    runs["key"], runs["class"] = joint[same], klass[:m][same]
    a, b, runs = _star(runs)
    pairs = np.zeros(len(a), _PAIR)
    pairs["a"], pairs["b"] = a, b
    pairs = np.unique(pairs)
    return [runs, pairs], [runs["key"], np.zeros(len(pairs), ts.U)]


def _packs(classes: np.ndarray, image: np.ndarray, found: np.ndarray, bits: int, votes: int, joint: bool = False, roots: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Joint keys of points, or their entries, dealt by segments; ``roots`` are the components of the classes."""
    klass = classes[image]
    kinds, keys = _runs(klass, image, found, votes) if joint else _entries(klass, found, klass if roots is None else roots[image])
    columns = []
    for rows, key in zip(kinds, keys):
        seg = (key >> ts.U(64 - bits)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        cut = np.searchsorted(seg[order], np.arange((1 << bits) + 1))
        rows = rows[order]
        parts = [rows[lo:hi] for lo, hi in zip(cut[:-1], cut[1:])]
        columns.append([(np.unique(x) if x.dtype == _PAIR else x).tobytes() for x in parts])
    full = [s for s in range(1 << bits) if any(c[s] for c in columns)]
    names = ["seg", "runs", "pairs"] if joint else ["seg", "entries", "roots"]
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array([c[s] for s in full], pa.binary()) for c in columns)], names)


def _numbered(rows: np.ndarray, *names: str) -> tuple[np.ndarray, np.ndarray]:
    """The classes of some rows, and the rows with their numbers in place of them."""
    classes, rows = np.unique(np.concatenate([rows[x] for x in names])), rows.copy()
    for x in names:
        rows[x] = np.searchsorted(classes, rows[x])
    return classes, rows


def _by_part(made: pa.RecordBatch, parts: int) -> pa.RecordBatch:
    """Entries of the segments of each part in one run, compressed."""
    seg, columns = made.column("seg").to_numpy(), [made.column(c).to_pylist() for c in ("entries", "roots")]
    full, out = np.unique(seg % parts), []
    for k in full.tolist():
        entries, roots = (b"".join(c[i] for i in np.flatnonzero(seg % parts == k).tolist()) for c in columns)
        rows = np.frombuffer(entries, _ENTRY)
        classes, rows = _numbered(rows[np.lexsort((rows["bits"], rows["class"]))], "class")
        out.append((len(classes).to_bytes(8, "little") + classes.tobytes() + _shrunk(rows), np.unique(np.frombuffer(roots, _PAIR)).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*out))], ["seg", "entries", "roots"])


def _own_classes(blob: bytes) -> np.ndarray:
    """The entries of a run of :func:`_by_part`."""
    n = int.from_bytes(blob[:8], "little")
    rows = _grown([blob[8 + 8 * n :]], _ENTRY)
    rows["class"] = np.frombuffer(blob, np.int64, n, 8)[rows["class"]]
    return rows


def _keyed(bits: int, votes: int, joint: bool, most: int = 1 << 16, dealt: int = 0):
    """Runs of :func:`_packs`, or compressed ones of so many parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, roots, parts, n = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            image = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            for made in _packs(np.array(classes), image, np.concatenate(parts), bits, votes, joint, np.array(roots)):
                yield _by_part(made, dealt) if dealt else made

        for batch in batches:
            for klass, root, blob in zip(*(batch.column(c).to_pylist() for c in ("class", "root", "points"))):
                classes.append(klass)
                roots.append(root)
                parts.append(np.frombuffer(blob, _POINT))
                n += len(parts[-1])
                if n >= most:
                    yield from flush()
                    classes, roots, parts, n = [], [], [], 0
        if n:
            yield from flush()

    return run


def _bytes_of(table: pa.Table, column: str, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _joined(seg: int, table: pa.Table) -> pa.Table:
    """Pairs of classes that share a joint key."""
    a, b, _ = _star(_bytes_of(table, "runs", _LINK))
    pairs = _bytes_of(table, "pairs", _PAIR)
    found = np.unique(np.stack([np.concatenate([a, pairs["a"]]), np.concatenate([b, pairs["b"]])], 1), axis=0)
    return pa.table({"a": found[:, 0], "b": found[:, 1]})


_MATCH = "p bigint, q bigint, ds int, dt int, hx bigint, hy bigint, spot bigint"


_TURNED = np.arange(TURNS) * (2 * np.pi / TURNS)


def _alike(e: np.ndarray, root: np.ndarray, left: np.ndarray, right: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs of entries of a bucket that match and lie in different components, the smaller class first."""
    bits = e["bits"]
    ok = np.flatnonzero((root[left] != root[right]) & (np.bitwise_count(bits[left] ^ bits[right]) <= distance))
    a, b = e[left[ok]], e[right[ok]]
    cut, band = _cut(a["bits"] ^ b["bits"]), a["place"] >> 6
    keep = band == b["place"] >> 6
    for k in range(BANDS - 1):  # one vote for descriptors that agree in several bands
        keep &= (band <= k) | (cut[k] != 0)
    a, b = a[keep], b[keep]
    swap = a["class"] > b["class"]
    return np.where(swap, b, a), np.where(swap, a, b)


def _spots(e: np.ndarray) -> np.ndarray:
    """Places that count once."""
    return (e["y"].astype(np.int64) // 4) << 32 | e["x"].astype(np.int64) // 4


def _votes(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """Rows as :data:`_MATCH` has them."""
    ds = (b["place"] & 63).astype(np.int64) - (a["place"] & 63)
    dt = (b["turn"].astype(np.int64) - a["turn"]) % TURNS
    zoom, cos, sin = STEP**ds, np.cos(_TURNED)[dt], np.sin(_TURNED)[dt]
    ax, ay = a["x"].astype(float), a["y"].astype(float)
    sx = b["x"] - zoom * (cos * ax - sin * ay)
    sy = b["y"] - zoom * (cos * ay + sin * ax)
    spot = _spots(a)
    half = [np.floor(v / (step / 2)).astype(np.int64) for v in (sx, sy)]
    return np.stack([a["class"], b["class"], ds, dt, *half, spot], 1)


def _pair_bits(n: int) -> int:
    """Bits of a hash of a pair of ``n`` classes: pairs that collide are counted together, which makes work and loses nothing."""
    return min(60, max(24, 2 * n.bit_length() - 4))


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start on, as many as its size, end to end, and whose they are."""
    whose = np.repeat(np.arange(len(size)), size)
    return start[whose] + np.arange(len(whose)) - (np.cumsum(size) - size)[whose], whose


def _runs_of(size: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose sizes add up to ``most`` at most, or one larger."""
    total, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield slice(lo, hi)
        lo = hi


def _crossed(bits: np.ndarray, root: np.ndarray, distance: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of one bucket, in order of bits and component, that lie in different components and at most ``distance`` bits apart."""
    new = np.ones(len(bits), bool)
    new[1:] = (bits[1:] != bits[:-1]) | (root[1:] != root[:-1])
    head = np.flatnonzero(new)
    size, bits, root = np.diff(np.append(head, len(new))), bits[head], root[head]
    high = max(1, most // len(head))
    for lo in range(0, len(head), high):
        part = slice(lo, lo + high)
        near = (np.bitwise_count(bits[part, None] ^ bits[lo:]) <= distance) & (root[part, None] != root[lo:])
        one, two = (x + lo for x in np.nonzero(near))
        one, two = one[one < two], two[one < two]
        for few in _runs_of(size[one], most):
            left, whose = _spread(head[one[few]], size[one[few]])
            right = two[few][whose]
            for some in _runs_of(size[right], most):
                b, whose = _spread(head[right[some]], size[right[some]])
                yield left[some][whose], b


def _bucketed(e: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The component of each entry, its key, and the order by key and bits."""
    roots, root = np.unique(roots), e["class"].copy()
    if len(roots):
        at = np.minimum(np.searchsorted(roots["a"], root), len(roots) - 1)
        root = np.where(roots["a"][at] == root, roots["b"][at], root)
    key, band = np.zeros(len(e), ts.U), e["place"] >> 6
    for k, value in enumerate(_cut(e["bits"])):
        key[band == k] = _band_key(value[band == k], k)
    return root, key, np.lexsort((e["place"], e["class"], root, e["bits"], key))


def _buckets(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and size of each bucket, and the place of each entry in its own."""
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(head, len(key)))
    return head, size, np.arange(len(key)) - np.repeat(head, size)


def _met(table: pa.Table, distance: int, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matches of entries of different components in the buckets of one segment, few of large ones."""
    e = _bytes_of(table, "entries", _ENTRY)
    root, key, _ = _bucketed(e, _bytes_of(table, "roots", _PAIR))
    order = np.lexsort((e["class"], e["bits"], key))
    e, root = e[order], root[order]
    head, size, place = _buckets(key[order])
    small = np.repeat(size <= bucket, size)
    for d in range(1, bucket):
        i = np.flatnonzero((place >= d) & small)
        if not len(i):
            break
        yield _alike(e, root, i - d, i, distance)
    i = np.flatnonzero(~small)
    yield _alike(e, root, np.repeat(head, size)[i], i, distance)
    i = i[place[i] >= 2]  # the second one has met its neighbour, the first
    yield _alike(e, root, i - 1, i, distance)


class _Groups:
    """Entries of some segments; those of one class with equal descriptors and scale are a group, which is paired as one."""

    def __init__(self, table: pa.Table):
        e = np.concatenate([_own_classes(x) for x in table.column("entries").to_pylist()])
        root, key, order = _bucketed(e, _bytes_of(table, "roots", _PAIR))
        self.rows, root, key = e[order], root[order], key[order]
        new = np.ones(len(e), bool)
        new[1:] = key[1:] != key[:-1]
        for name in ("bits", "class", "place"):
            new[1:] |= self.rows[name][1:] != self.rows[name][:-1]
        self.head = np.flatnonzero(new)
        self.size = np.diff(np.append(self.head, len(e)))
        one = self.rows[self.head]
        self.klass, self.bits = np.ascontiguousarray(one["class"]), np.ascontiguousarray(one["bits"])
        self.mixed = ts.mix(self.klass.view(ts.U))
        self.band, self.scale = one["place"] >> 6, (one["place"] & 63).astype(ts.U)
        self.root, self.key = root[self.head], key[self.head]

    def _first(self, left: np.ndarray, right: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of one bucket that match and lie in different components, in the first band in which they agree, the smaller class first."""
        differ = self.bits[left] ^ self.bits[right]
        ok = np.flatnonzero(np.bitwise_count(differ) <= distance)
        left, right, cut, band = left[ok], right[ok], _cut(differ[ok]), self.band[left[ok]]
        keep = self.root[left] != self.root[right]
        for k in range(BANDS - 1):
            keep &= (band <= k) | (cut[k] != 0)
        left, right = left[keep], right[keep]
        swap = self.klass[left] > self.klass[right]
        return np.where(swap, right, left), np.where(swap, left, right)

    def met(self, distance: int, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of groups of different components that match, the smaller class first."""
        head, size, place = _buckets(self.key)
        for d in range(1, bucket):
            i = np.flatnonzero((place >= d) & np.repeat(size <= bucket, size)) if d == 1 else i[place[i] >= d]
            if not len(i):
                break
            yield self._first(i - d, i, distance)
        for lo, n in zip(head[size > bucket].tolist(), size[size > bucket].tolist()):
            for left, right in _crossed(self.bits[lo : lo + n], self.root[lo : lo + n], distance):
                yield self._first(left + lo, right + lo, distance)

    def hashes(self, left: np.ndarray, right: np.ndarray, kept: int) -> np.ndarray:
        """Hashes of pairs of classes and the change of scale, of which so many upper bits are kept."""
        low, zoom = ts.U(64 - kept), (self.scale[right] - self.scale[left]) << ts.U(56)
        return ts.mix(self.mixed[left] + self.klass[right].view(ts.U) + zoom) >> low << low

    def spots(self) -> np.ndarray:
        """How many places each group has, as votes count them."""
        whose = np.repeat(np.arange(len(self.head)), self.size)
        spot = _spots(self.rows)
        order = np.lexsort((spot, whose))
        whose, spot = whose[order], spot[order]
        new = np.ones(len(spot), bool)
        new[1:] = (whose[1:] != whose[:-1]) | (spot[1:] != spot[:-1])
        return np.bincount(whose[new], minlength=len(self.head))

    def points(self, left: np.ndarray, right: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of entries of pairs of groups, about ``most`` at once."""
        for few in _runs_of(self.size[left], most):
            a, whose = _spread(self.head[left[few]], self.size[left[few]])
            other = right[few][whose]
            for some in _runs_of(self.size[other], most):
                b, whose = _spread(self.head[other[some]], self.size[other[some]])
                yield self.rows[a[some][whose]], self.rows[b]


def _counted(distance: int, bucket: int, bits: int, kept: int, most: int = 1 << 22):
    """How many places of the first class may match, for each pair of classes and change of scale in some segments, dealt by hash: steps between the sorted hashes, compressed."""

    def run(table: pa.Table) -> pa.Table:
        groups, held, n, made = _Groups(table), [], 0, []
        spots = np.minimum(groups.spots(), 255).astype(np.uint8)

        def flush() -> None:
            values, which = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            counts = np.bincount(which, np.concatenate([x for _, x in held])).astype(np.int64)
            cut = np.searchsorted(values >> ts.U(64 - bits), np.arange((1 << bits) + 1, dtype=ts.U))
            for k in np.flatnonzero(np.diff(cut)).tolist():
                part = slice(cut[k], cut[k + 1])
                steps = np.diff(values[part] >> ts.U(64 - kept), prepend=ts.U(0))
                made.append((k, _shrunk(steps), _shrunk(np.minimum(counts[part], 255).astype(np.uint8))))

        for left, right in groups.met(distance, bucket):
            held.append((groups.hashes(left, right, kept), spots[left]))
            n += len(left)
            if n >= most:
                flush()
                held, n = [], 0
        if n:
            flush()
        kinds = (pa.int32(), pa.binary(), pa.binary())
        columns = list(zip(*made)) or [(), (), ()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["seg", "hashes", "counts"])

    return run


def _enough(votes: int, kept: int):
    """Hashes of pairs with ``votes`` at least in all segments."""

    def run(seg: int, table: pa.Table) -> pa.Table:
        values = np.concatenate([np.cumsum(_grown([x], np.dtype(ts.U))) for x in table.column("hashes").to_pylist()])
        counts = _grown(table.column("counts").to_pylist(), np.dtype(np.uint8))
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        head = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        total = np.add.reduceat(counts.astype(np.int64), head)
        found = values[head][total >= votes] << ts.U(64 - kept)
        blob = lambda x: pa.array([x.tobytes()], pa.binary())
        made = pa.table({"seg": pa.array([seg], pa.int32()), "hashes": blob(found), "counts": blob(np.ones(len(found), np.uint32))})
        return made if len(found) else made.slice(0, 0)

    return run


def _agreeing(rows: np.ndarray, votes: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of :data:`_VOTE`: the pairs that have ``votes`` places in one cell, and the rows of all others.

    Turn and origin are voted for in a grid and in the same grid moved by half a cell.
    """
    if not len(rows):
        return np.zeros(0, _PAIR), rows
    rows = rows[np.lexsort((rows["q"], rows["p"]))]
    head = np.flatnonzero(np.concatenate([[True], (rows["p"][1:] != rows["p"][:-1]) | (rows["q"][1:] != rows["q"][:-1])]))
    size = np.diff(np.append(head, len(rows)))
    enough = np.repeat(size >= votes, size)
    some, pair, good = rows[enough], np.repeat(np.arange(len(head)), size)[enough], np.zeros(len(head), bool)
    for g in (0, 1):
        turn = (some["dt"] + 2 * g) // 4 % (TURNS // 4)
        cells = [some["spot"], (some["hy"] + g) // 2, (some["hx"] + g) // 2, turn, some["ds"], pair]
        order = np.lexsort(cells)
        moved = [np.concatenate([np.ones(min(1, len(c)), bool), c[order][1:] != c[order][:-1]]) for c in cells]
        cell = np.logical_or.reduce(moved[1:])
        number = np.cumsum(cell) - 1
        n = np.bincount(number[cell | moved[0]], minlength=int(cell.sum()))
        good[pair[order][cell][n >= votes]] = True
    pairs = np.zeros(int(good.sum()), _PAIR)
    pairs["a"], pairs["b"] = rows["p"][head[good]], rows["q"][head[good]]
    return pairs, rows[~np.repeat(good, size)]


def _decided(distance: int, bucket: int, step: int, votes: int, wanted, bits: int, kept: int, parts: int, most: int = 1 << 20):
    """Of pairs of classes in the broadcast filter ``wanted``: those that these segments link, and the votes of the others, dealt by pair."""

    def run(table: pa.Table) -> pa.Table:
        groups, held, n, made = _Groups(table), [], 0, []

        def flush() -> None:
            pairs, rows = _agreeing(np.concatenate(held), votes)
            cuts = []
            for x, (a, b) in ((rows, ("p", "q")), (pairs, ("a", "b"))):
                own = (ts.mix(ts.mix(x[a].astype(ts.U)) + x[b].astype(ts.U)) >> ts.U(32)).astype(np.int64) % parts
                order = np.argsort(own, kind="stable")
                cuts.append((x[order], np.searchsorted(own[order], np.arange(parts + 1))))
            for k in range(parts):
                rows, pairs = (x[cut[k] : cut[k + 1]] for x, cut in cuts)
                if len(rows) or len(pairs):
                    classes, rows = _numbered(rows, "p", "q")
                    made.append((k, classes.tobytes(), _shrunk(rows), _shrunk(pairs)))

        for left, right in groups.met(distance, bucket):
            keep = segments.bloom_probe(wanted.value, bits, groups.hashes(left, right, kept))
            for a, b in groups.points(left[keep], right[keep], most):
                held.append(np.ascontiguousarray(_votes(a, b, step)).view(_VOTE).ravel())
                n += len(a)
                if n >= most:
                    flush()
                    held, n = [], 0
        if n:
            flush()
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        columns = list(zip(*made)) or [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["seg", "classes", "votes", "pairs"])

    return run


def _agreed(votes: int):
    """The links among pairs whose votes, or links of single segments, have come together."""

    def run(seg: int, table: pa.Table) -> pa.Table:
        held = [np.zeros(0, _VOTE)]
        for classes, blob in zip(table.column("classes").to_pylist(), table.column("votes").to_pylist()):
            rows, classes = _grown([blob], _VOTE), np.frombuffer(classes, np.int64)
            rows["p"], rows["q"] = classes[rows["p"]], classes[rows["q"]]
            held.append(rows)
        late, _ = _agreeing(np.concatenate(held), votes)
        found = np.unique(np.concatenate([late, _grown(table.column("pairs").to_pylist(), _PAIR)]))
        return pa.table({"a": found["a"], "b": found["b"]})

    return run


def _matches(distance: int, bucket: int, step: int):
    """Matches of one segment, as votes.

    A match states a change of scale, a turn, and where the other image's origin then lies;
    the origin is given in halves of a cell of ``step`` pixels.
    """

    def run(seg: int, table: pa.Table) -> pa.Table:
        rows = [np.zeros((0, 7), np.int64)] + [_votes(a, b, step) for a, b in _met(table, distance, bucket)]
        rows = np.unique(np.concatenate(rows), axis=0)
        names = [x.split()[0] for x in _MATCH.split(", ")]
        found = pa.table({x: rows[:, k] for k, x in enumerate(names)})
        return found.cast(pa.schema([(x, pa.int32() if x in ("ds", "dt") else pa.int64()) for x in names]))

    return run


def _whole(held: DataFrame, n: int, size: int, votes: int, distance: int, bucket: int, step: int, bits: int) -> DataFrame:
    """Links by consensus of all entries, dealt once: pairs that may have votes enough are counted, then decided."""
    context, kept = held.sparkSession.sparkContext, _pair_bits(n)
    parts = min(1 << bits, max(2 * context.defaultParallelism, size >> 24))
    dealt = segments.dealt(held.mapInArrow(_keyed(bits, votes, False, 1 << 18, parts), _PACKED), parts)
    packed = segments.by_dealt(dealt, _counted(distance, bucket, bits, kept), segments.SCHEMA)
    enough = segments.by_segment(packed, _enough(min(votes, 255), kept), segments.SCHEMA)
    wanted = context.broadcast(segments.bloom_filter(enough, 1, segments.filter_bytes(8 * n, 16 << 20, bits), bits))
    decided = segments.by_dealt(dealt, _decided(distance, bucket, step, votes, wanted, bits, kept, max(1, parts // 2)), _AGREED)
    found = common.materialise(segments.by_segment(decided, _agreed(votes), "a bigint, b bigint"), "agreed")
    wanted.destroy()
    return found


def links(known: DataFrame, votes: int = 5, distance: int = 5, bucket: int = 32, step: int = 24, whole: bool = False) -> DataFrame:
    """Pairs ``a, b`` of classes of rows ``class, points``, by a joint key, or by consensus beyond the components of those."""
    sizes = known.groupBy("class").agg(F.max(F.octet_length("points")).alias("n"))
    total, n = sizes.agg(F.sum("n"), F.count("*")).first()
    size = (total or 0) * BANDS * _ENTRY.itemsize // _POINT.itemsize
    bits = segments.segment_bits(size)
    made = known.select("class", F.col("class").alias("root"), "points").mapInArrow(_keyed(bits, votes, True), _JOINT)
    joint = common.materialise(segments.by_segment(made, _joined, "a bigint, b bigint"), "joint")
    held = known.groupBy("class").agg(F.min("points").alias("points"))
    if joint.head(1):
        root = common.components(joint).withColumnRenamed("node", "class")
        held = held.join(root, "class", "left")
    else:
        held = held.withColumn("root", F.col("class"))
    held = held.select("class", F.coalesce("root", "class").alias("root"), "points")
    if whole:
        return _whole(held, n, size, votes, distance, bucket, step, bits).unionByName(joint.distinct())
    made = held.mapInArrow(_keyed(bits, votes, False), _PACKED)
    match = common.materialise(segments.by_segment(made, _matches(distance, bucket, step), _MATCH), "matches")
    # turn and origin are voted for in a grid and in the same grid moved by half a cell; all votes of a pair meet in one shuffle
    votes_of = match.repartition("p", "q").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("g"))
    cell = lambda h: F.floor((F.col(h) + F.col("g")) / 2).alias("c" + h)
    turn = (F.floor((F.col("dt") + 2 * F.col("g")) / 4) % (TURNS // 4)).alias("turn")
    cells = votes_of.select("p", "q", "g", "ds", turn, cell("hx"), cell("hy"), "spot").distinct()
    tally = cells.groupBy("p", "q", "g", "ds", "turn", "chx", "chy").agg(F.count("*").alias("n")).filter(F.col("n") >= votes)
    return tally.select(F.col("p").alias("a"), F.col("q").alias("b")).unionByName(joint).distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs as stars: those of a task, each with the smallest class that they lead to."""
    found = [np.stack([x.column(c).to_numpy() for c in ("a", "b")]) for x in batches]
    nodes, ends = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *found], 1), return_inverse=True)
    (a, b), root, before = ends.reshape(2, -1), np.arange(len(nodes)), None
    while before is None or (root != before).any():
        before = root.copy()
        low = np.minimum(root[a], root[b])
        for x in (root[a], root[b], a, b):
            np.minimum.at(root, x, low)
        root = root[root]
    kept = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[root[kept]]), pa.array(nodes[kept])], ["a", "b"])


def descriptors(images: DataFrame, kind: str, scales: int = 4, apart: int = 8) -> DataFrame:
    """``id, class, points`` of ``id, class, image``; points are packed as :data:`_POINT` has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                got = describe([decode(x) for x in part.column(2).to_pylist()], scales, apart)
                cut = np.searchsorted(got[:, 0], np.arange(part.num_rows + 1))
                points = np.zeros(len(got), _POINT)
                for k, name in enumerate(_POINT.names, 1):
                    points[name] = got[:, k].view(ts.U) if name == "bits" else got[:, k]
                blobs = [points[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(blobs, pa.binary())], ["id", "class", "points"])

    return images.select("id", "class", "image").mapInArrow(run, f"id {kind}, class bigint, points binary")


def copies(images: DataFrame, votes: int = 5, distance: int = 5, bucket: int = 32, scales: int = 4, apart: int = 8, id_col: str = "image_id", image_col: str = "image", whole: bool = False) -> DataFrame:
    """``id, class, component, n_descriptors``: the class of equal images, the smallest id of all copies."""
    kind = images.schema[id_col].dataType.simpleString()
    rows = images.select(F.col(id_col).alias("id"), F.coalesce(F.col(image_col).cast("binary"), F.lit(b"")).alias("image"))
    rows = rows.select("id", F.xxhash64("image").alias("class"), "image")
    known = common.materialise(descriptors(rows, kind, scales, apart), "descriptors")
    since = len(common.written(images.sparkSession))
    found = common.materialise(links(known.select("class", "points"), votes, distance, bucket, whole=whole), "consensus")
    lows = known.groupBy("class").agg(F.min("id").alias("low"))
    if found.head(1):
        root = common.components(found.mapInArrow(_forest, "a bigint, b bigint")).withColumnRenamed("node", "class")
        common.keep_last(images.sparkSession, since)
        lows = lows.join(root, "class", "left")
    else:
        lows = lows.withColumn("root", F.col("class"))
    named = lows.select("class", "low", F.coalesce("root", "class").alias("root"))
    best = named.groupBy("root").agg(F.min("low").alias("component"))
    named = common.fresh_join(named, best, ["root"]).select("class", "component")
    light = known.select("id", "class", (F.octet_length("points") / _POINT.itemsize).cast("bigint").alias("n_descriptors"))
    return common.fresh_join(light, named, ["class"]).select("id", F.lower(F.lpad(F.hex("class"), 16, "0")).alias("class"), "component", "n_descriptors")


def page_images(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", width: int = 16) -> DataFrame:
    """``image_id, image``: each page drawn as a grey PGM, the media column of the queries.

    A paragraph is drawn line by line, ``width`` words a line, a block a word, its grey pattern a
    hash of the word; so pages that share paragraphs are images that share bands, perhaps
    shifted.  The canvas grows with the page: every word of the whole text is drawn once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in ts.chunks(batch, "t"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(draw(raw, at, width), pa.binary())], ["image_id", "image"])

    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"image_id {rows.schema['id'].dataType.simpleString()}, image binary")


def draw(raw: np.ndarray, at: np.ndarray, width: int = 16) -> list[bytes]:
    """PGMs of texts: blocks of 4 by 4 pixels, ``width`` of them a line; a text without words has one blank line."""
    raw = np.frombuffer(raw.tobytes().replace(b"</p>", b"\n   ").replace(b"<br>", b"\n   "), np.uint8)
    words = ts.Words(raw, at)
    n, doc = len(at) - 1, words.doc()
    line = np.concatenate([[0], np.cumsum(raw == 10)])[words.start]
    new = np.ones(len(words), bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    rank = np.cumsum(new) - 1  # paragraphs with words, over all texts
    inner = np.arange(len(words)) - heads[rank] if len(heads) else np.zeros(0, np.int64)
    lines = -(-np.diff(np.append(heads, len(words))) // width)  # of each paragraph
    top = np.cumsum(lines) - lines
    row, j = (top[rank] + inner // width, inner % width) if len(heads) else (inner, inner)
    owner = doc[heads] if len(heads) else doc
    rows = np.bincount(owner, lines, n).astype(np.int64)
    first = np.cumsum(rows) - rows
    h = words.hashes()
    canvas = np.zeros((int(rows.sum()), width, 4), np.uint8)
    canvas[row, j] = h.view(np.uint8).reshape(-1, 8)[:, 4:]
    pixels = canvas.reshape(-1, width, 2, 2).transpose(0, 2, 1, 3).reshape(-1, width * 2).repeat(2, 0).repeat(2, 1)
    out = []
    for a, b in zip((4 * first).tolist(), (4 * (first + rows)).tolist()):
        body = pixels[a:b].tobytes() or bytes(16 * width)
        out.append(b"P5\n%d %d\n255\n" % (4 * width, len(body) // (4 * width)) + body)
    return out
