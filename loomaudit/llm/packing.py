"""Packing of tokenised texts by bounded-space best fit.

Each task tokenises its texts and cuts them at ``length`` tokens.  Full cuts are
sequences of their own; a rest goes into the open window with the least room that
still holds it.  At most ``windows`` windows are open in a task: when none fits and
all are open, the fullest is emitted and a new one opened.  What is open at a
task's end is merged: the leftovers of ``together`` tasks are laid end to end and
cut at sequence bounds, so only the last sequence of such a group has much padding.
A task's memory is its open windows and one run of texts, whatever the input.

Token ids come from a ``tokenizers`` file with byte-level BPE.  Texts are cut into
the tokenizer's own pre-tokens in numpy, and the library encodes each distinct
pre-token once; texts with characters whose class may depend on the Unicode
version are encoded whole.

Defined cases: a null text is empty, and an empty text is its end id alone; rows
with equal ids are packed each; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textscan as ts

_SPACE, _LETTER, _NUMBER, _OTHER, _UNSURE = range(5)
#: Characters of the White_Space property: fixed values.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Suffixes that the pre-tokeniser splits off after an apostrophe: fixed values.
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes() -> np.ndarray:
    """Class of each character of the basic plane; unsure if it changed since Unicode 3.2."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.full(0x10000, _UNSURE, np.uint8)
    old = unicodedata.ucd_3_2_0
    for c in range(0x10000):
        now = unicodedata.category(chr(c))
        if now == old.category(chr(c)) and now not in ("Cn", "Cs", "Co"):
            out[c] = kinds.get(now[0], _OTHER)
    out[_WHITE] = _SPACE
    return out


class _Generation:
    """Pre-tokens met lately, with their ids end to end."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.ids, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def find(self, texts: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.get, texts, itertools.repeat(-1)), np.int64, len(texts))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these rows end to end, and how many each has."""
        size = self.begin[rows + 1] - self.begin[rows]
        return self.ids[_ranges(self.begin[rows], size)], size

    def add(self, texts: list[bytes], ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        rows = np.arange(len(self.begin) - 1, len(self.begin) - 1 + len(texts))
        self.known.update(zip(texts, rows.tolist()))
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(size))
        self.ids = np.append(self.ids, ids)
        return rows


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, end to end."""
    total = np.cumsum(size)
    return np.repeat(start - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)


class Tokens:
    """Ids of many texts at once.

    Pre-tokens are kept in two generations of bounded size that live as long as a task:
    when the younger is full it becomes the elder, and what is met again moves on.
    """

    _by_file: dict[str, Tokens] = {}
    MOST = 100_000

    def __init__(self, file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(file)
        self.model.encode_special_tokens = True
        self.classes = _classes()
        self.line_feed = self.model.encode("\n", add_special_tokens=False).ids
        self.forget()

    @classmethod
    def of(cls, file: str) -> Tokens:
        if file not in cls._by_file:
            cls._by_file[file] = cls(file)
        return cls._by_file[file]

    def forget(self) -> None:
        """Empty the cache: workers are reused, and other stages need their memory."""
        self.young, self.old = _Generation(), _Generation()

    def _starts(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions at which pre-tokens start, and which texts are unsure."""
        lead = (raw & 0xC0) != 0x80
        first = np.concatenate([[0], np.cumsum(lead)])[at]  # each text's first character
        chars = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(chars)
        kind = self.classes[np.minimum(chars, 0xFFFF)]
        kind[chars > 0xFFFF] = _UNSURE
        unsure = np.zeros(len(at) - 1, bool)
        odd = np.flatnonzero(kind == _UNSURE)
        unsure[np.searchsorted(first, odd, "right") - 1] = True
        begin = np.zeros(n + 1, bool)
        begin[first] = True
        change = begin[:n].copy()
        change[1:] |= kind[1:] != kind[:-1]
        white = kind == _SPACE
        blank = np.zeros(n, bool)  # a plain space before, in the same text
        blank[1:] = (chars[:-1] == 0x20) & ~begin[1:n]
        start = change & (white | ~blank)
        ends = np.zeros(n, bool)  # white space before something else, in the same text
        ends[:-1] = white[:-1] & ~white[1:] & ~begin[1:n]
        start |= ends
        start |= begin[:n]
        quote = np.flatnonzero((chars == 0x27) & start)
        quote = quote[quote + 1 < n]
        quote = quote[(kind[quote + 1] == _LETTER) & ~begin[quote + 1] & change[quote]]
        for i in quote.tolist():
            after = "".join(map(chr, chars[i + 1 : i + 3]))
            for s in _SUFFIXES:
                if after.startswith(s) and not begin[i + 1 : i + 1 + len(s)].any():
                    start[i + 1 : i + 1 + len(s)] = False
                    if i + 1 + len(s) < n:
                        start[i + 1 + len(s)] |= not white[i + 1 + len(s)] or bool(change[i + 1 + len(s)])
                    break
        return np.flatnonzero(lead)[start], unsure

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes], together: int = 256) -> np.ndarray:
        """Have the library encode pre-tokens that are in neither generation.

        A line feed before or after a pre-token that is no white space is a pre-token of its
        own, so many go as lines of one text, which costs less than as many texts.
        """
        texts = [w.decode("utf-8") for w in words]
        lines = [i for i, x in enumerate(texts) if not x.isspace()] if len(self.line_feed) == 1 else []
        joined = ["\n".join([*(texts[i] for i in lines[k : k + together]), ""]) for k in range(0, len(lines), together)]
        ids = np.fromiter(itertools.chain.from_iterable(self._ids(joined)), np.uint32)
        ends = np.flatnonzero(ids == self.line_feed[0]) if len(lines) else np.zeros(0, np.int64)
        size = np.diff(ends, prepend=-1) - 1
        rows = np.empty(len(words), np.int64)
        rows[lines] = self.young.add([words[i] for i in lines], ids[ids != self.line_feed[0]], size)
        rest = sorted({*range(len(words))} - {*lines}) if len(lines) < len(words) else []
        found = self._ids([texts[i] for i in rest])
        size = np.array([len(x) for x in found], np.int64)
        rows[rest] = self.young.add([words[i] for i in rest], np.array([i for x in found for i in x], np.uint32), size)
        return rows

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts, and each text's first index."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        start, unsure = self._starts(raw, at)
        end = np.append(start[1:], len(raw))
        first, back = _distinct(raw, start, end)
        view = raw.tobytes()
        texts = [view[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
        if len(self.young.known) > self.MOST:
            self.young, self.old = _Generation(), self.young
        rows = self.young.find(texts)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            words = [texts[i] for i in missing.tolist()]
            before = self.old.find(words)
            met, new = np.flatnonzero(before >= 0), np.flatnonzero(before < 0)
            rows[missing[met]] = self.young.add([words[i] for i in met.tolist()], *self.old.take(before[met]))
            rows[missing[new]] = self._learn([words[i] for i in new.tolist()])
        where, each = self.young.begin[rows][back], np.diff(self.young.begin)[rows][back]
        total = np.cumsum(each)
        ids = self.young.ids[_ranges(where, each)]
        bounds = np.append(0, total)[np.searchsorted(start, at)]
        if unsure.any():
            parts = []
            for d in range(len(at) - 1):
                whole = view[at[d] : at[d + 1]].decode("utf-8") if unsure[d] else None
                parts.append(np.array(self.model.encode(whole, add_special_tokens=False).ids, np.uint32) if unsure[d] else ids[bounds[d] : bounds[d + 1]])
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds


def _distinct(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A representative of each distinct slice, and each slice's number; bytes decide, not their hashes."""
    _, first, back = np.unique(ts.slice_hashes(raw, start, end), return_index=True, return_inverse=True)
    size = end - start
    odd = np.flatnonzero((size != size[first][back]) | ~ts.same_slices(raw, start, size, start[first][back]))
    back[odd] = len(first) + np.arange(len(odd))  # collisions stand for themselves
    return np.concatenate([first, odd]), back


class BestFit:
    """Open windows of one task."""

    def __init__(self, length: int, windows: int):
        self.length, self.windows = length, windows
        self.rooms: list[tuple[int, int]] = []  # (room, window), ascending
        self.held: dict[int, list] = {}
        self.opened = 0

    def place(self, size: int, piece: tuple) -> tuple[int, list] | None:
        """Put away a piece shorter than a window; returns a window that is full or had to be emitted."""
        out = None
        i = bisect.bisect_left(self.rooms, (size, -1))
        if i == len(self.rooms):
            if len(self.rooms) == self.windows:
                _, fullest = self.rooms.pop(0)
                out = fullest, self.held.pop(fullest)
            room, window = self.length, self.opened
            self.opened += 1
            self.held[window] = []
        else:
            room, window = self.rooms.pop(i)
        self.held[window].append((self.length - room, *piece))
        if room > size:
            bisect.insort(self.rooms, (room - size, window))
            return out
        return window, self.held.pop(window)  # full; a piece is shorter than a window, so no new one is

    def rest(self) -> list[tuple[int, list]]:
        return sorted(self.held.items())


_PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """rows: id, start, length, crc, doc_tokens, sequence, offset, leftover, group, ids."""
    types = [kind, *[pa.int64()] * 6, pa.bool_(), pa.int32(), pa.binary()]
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "leftover", "grp", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _pack(file: str, length: int, windows: int, together: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, fit, task = Tokens.of(file), BestFit(length, windows), TaskContext.get().partitionId()
        group, serial, kind = task // together, 0, None
        out: list[tuple] = []

        def emit(pieces: list, leftover: bool) -> None:
            nonlocal serial
            for offset, who, start, ids, n in pieces:
                raw = ids.tobytes()
                out.append((who, start, len(ids), zlib.crc32(raw), n, task << 32 | serial, offset, leftover, group, raw if with_ids or leftover else None))
            serial += 1

        for batch in batches:
            kind = batch.schema.field(0).type
            for part, raw, at in ts.chunks(batch, "t"):
                ids, bounds = tokens.encode(raw, at)
                for d, who in enumerate(part.column(0).to_pylist()):
                    own = np.append(ids[bounds[d] : bounds[d + 1]], np.uint32(end_id)).astype("<u4")
                    n = len(own)
                    for lo in range(0, n, length):
                        piece = own[lo : lo + length]
                        if len(piece) == length:
                            emit([(0, who, lo, piece, n)], False)
                        elif (done := fit.place(len(piece), (who, lo, piece, n))) is not None:
                            emit(done[1], False)
                    if len(out) >= 1024:
                        yield _batch(out, kind)
                        out.clear()
        tokens.forget()
        for _, pieces in fit.rest():
            emit(pieces, True)
        if out:
            yield _batch(out, kind)

    return run


def _merge(length: int, with_ids: bool):
    """Lay the leftovers of a group end to end; cut at sequence bounds."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.schema.field("id").type
        rows = sorted(table.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
        names = sorted({r["sequence_id"] for r in rows})  # at least as many as sequences are needed
        out, at = [], 0
        for r in rows:
            ids, done = np.frombuffer(r["ids"], "<u4"), 0
            while done < len(ids):
                take = min(len(ids) - done, length - at % length)
                raw = ids[done : done + take].tobytes()
                out.append((r["id"], r["start"] + done, take, zlib.crc32(raw), r["doc_tokens"], names[at // length], at % length, True, r["grp"], raw if with_ids else None))
                done, at = done + take, at + take
        return pa.Table.from_batches([_batch(out, kind)])

    return run


def pack(
    docs: DataFrame,
    vocabulary: str,
    length: int = 1024,
    windows: int = 64,
    together: int = 64,
    end_id: int = 0,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are little-endian unsigned 32-bit numbers, null without ``with_ids``;
    ``ids_crc32`` is their checksum in either case.  ``vocabulary`` is the path of the
    tokenizer file on every worker.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    schema = f"id {kind}, {_PIECE}, leftover boolean, grp int, ids binary"
    with common.small_batches(docs.sparkSession):
        placed = common.materialise(rows.mapInArrow(common.lean(_pack(vocabulary, length, windows, together, end_id, with_ids)), schema), "pieces")
    rest = placed.filter("leftover").groupBy("grp").applyInArrow(_merge(length, with_ids), schema)
    return placed.filter("not leftover").unionByName(rest).drop("leftover", "grp")
