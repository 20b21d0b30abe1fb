"""Bounded-space online packing of tokenised documents into windows of fixed length.

Each partition keeps at most `open_windows` windows. A document's ids are cut at full
windows; what is left goes best-fit into the open window with the least room that
still holds it. Where none fits and no more may be opened, the fullest window takes
as much as fills it and is emitted, and the rest is placed again. At its end a
partition joins its open windows, so it hands on less than one window; those tails
are finally strung together over all partitions and cut again. The last tail becomes
windows whose lengths are powers of two, so nothing is padded at all.

Defined results: null text is empty (its end token alone is packed); a null or
repeated doc_id is carried as it is; ties take the window opened first; an empty
table gives no rows; extra columns are not read.

Scale: one pass, memory of `open_windows` windows and one document per task, no
shuffle of tokens. A partition's tail (under one window) is the only thing merged;
the prefix sum that places the tails is over two integers per partition.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalake.llm.common import KEPT, arrow_map, chunks, cut, utf8, word_table

WINDOW, OPEN, END = 4096, 64, 2
TOKENIZER = "word_bpe_49k.json"
CACHE, PIECES = 600_000, 60_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _letters() -> str:
    import unicodedata

    return "".join(chr(c) for c in range(0x80, 0x17F) if unicodedata.category(chr(c))[0] == "L" and c != 0x130)


#: Bytes of odd characters: controls, and leads of U+0080..U+00BF and of all from U+0180.
_RARE = np.zeros(256, bool)
_RARE[[*(b for b in range(32) if b not in (9, 10, 11, 12, 13)), 0x7F, 0xC2, *range(0xC6, 0x100)]] = True
MARK = b"\xff\xff\xff\xff"


def _same(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, back: np.ndarray, first: np.ndarray) -> bool:
    """Whether every word equals the first of its hash, byte by byte."""
    like = first[back]
    if (lens != lens[like]).any():
        return False
    for i in range(0, len(lens), 8192):
        n, to = lens[i : i + 8192], starts[like[i : i + 8192]]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if (data.take(np.repeat(starts[i : i + 8192], n) + at) != data.take(np.repeat(to, n) + at)).any():
            return False
    return True


def _by_bytes(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, first places, numbers of all words) of distinct words, told apart by their bytes."""
    seen: dict[bytes, int] = {}
    back = np.array([seen.setdefault(data[a : a + n].tobytes(), len(seen)) for a, n in zip(starts, lens, strict=True)], np.int64)
    _, first = np.unique(back, return_index=True)
    return np.arange(len(seen)), first, back


class WordTokenizer:
    """Ids of texts, as rows of little-endian 32-bit words.

    The vocabulary is a BPE over pre-split words in lower case, so a text's ids are those
    of its words. Equal words of a batch are found by a 64-bit hash and compared byte by
    byte; across batches words are looked up by their bytes. Each new one is split as the
    tokenizer splits it, and pieces not met before are encoded by the tokenizer, many to
    a call with a line break between them. This holds for the plain Latin characters
    below U+017F; a text with any other character, or with a special token's opening,
    is encoded whole. At most CACHE words and PIECES pieces are kept, then all go (a batch
    may end above that).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters = _letters()
        self.odd = re.compile(f"[^\\t\\n\\v\\f\\r -~{letters}]").search
        self.split = re.compile(f"'(?:[stmd]|re|ve|ll)|[a-z{letters}]+|[0-9]|\\n|[^\\sa-z0-9{letters}]+").findall
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.pieces: dict[str, bytes] = {"\n": MARK}
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _pieces(self, new: list[str]) -> None:
        groups = [new[i : i + 64] for i in range(0, len(new), 64)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(group):
                raise ValueError("the vocabulary does not mark word ends")
            raw, at = ids.tobytes(), 0
            for piece, end in zip(group, (4 * ends).tolist(), strict=True):
                self.pieces[piece] = raw[at:end]
                at = end

    def _add(self, words: list[bytes]) -> None:
        if len(self.pieces) > PIECES:
            self.pieces = {"\n": MARK}
        flat = self.split(b"\n".join(words).decode().lower() + "\n")
        if missing := list(set(flat) - self.pieces.keys()):
            self._pieces(missing)
        ids = np.frombuffer(b"".join(map(self.pieces.__getitem__, flat)), "<u4")
        stop = np.flatnonzero(ids == 0xFFFFFFFF)
        size = np.diff(stop, prepend=-1) - 1
        ids = ids[ids != 0xFFFFFFFF]
        n, need = len(self.slot), self.used + len(ids)
        while len(self.ids) < need:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.start) < n + len(words):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.ids[self.used : need] = ids
        self.start[n : n + len(words)] = self.used + np.cumsum(size) - size
        self.size[n : n + len(words)] = size
        self.used = need
        self.slot.update(zip(words, range(n, n + len(words)), strict=True))

    @staticmethod
    def _plain(data: np.ndarray) -> bool:
        """Whether rows can hold no odd character, by their bytes alone."""
        raw = data.tobytes()
        return not _RARE.take(data).any() and not any(x in raw for x in (b"<|", b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0", b"\xc5\xbf"))

    def __call__(self, col: pa.Array) -> list[bytes]:
        """The ids of each row; null is empty."""
        data, off = utf8(col)
        starts, lens, h, counts = word_table(data, off, lower=False)
        if len(self.slot) > CACHE:
            self.clear()
        order = np.argsort(h)
        ranked = h[order]
        edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(h) else np.zeros(0, np.int64)
        u, first = ranked[edge], order[edge]
        back = np.empty(len(h), np.int64)
        back[order] = np.repeat(np.arange(len(u)), np.diff(edge, append=len(h)))
        if not _same(data, starts, lens, back, first):
            u, first, back = _by_bytes(data, starts, lens)
        raw, base = data[off[0] : off[-1]].tobytes(), int(off[0])
        key = [raw[a : a + n] for a, n in zip((starts[first] - base).tolist(), lens[first].tolist(), strict=True)]
        slots = np.fromiter((self.slot.get(x, -1) for x in key), np.int64, len(key))
        odd = {} if self._plain(data[off[0] : off[-1]]) else {k: t for k, t in enumerate(col.to_pylist()) if t and ("<|" in t or self.odd(t))}
        if len(new := np.flatnonzero(slots < 0)):
            at = first[new]
            row = np.searchsorted(np.cumsum(counts), at, side="right")
            good = ~np.isin(row, list(odd)) if odd else np.ones(len(at), bool)
            if odd:
                # a word first met in an odd row may stand in a plain row too
                plain = ~np.isin(np.repeat(np.arange(len(counts)), counts), list(odd))
                where = np.full(len(u), -1)
                where[back[plain][::-1]] = np.flatnonzero(plain)[::-1]
                at = where[new]
                good = at >= 0
            new, at = new[good], at[good]
            slots[new] = np.arange(len(self.slot), len(self.slot) + len(new))
            self._add([key[k] for k in new.tolist()])
        own = slots[back]
        size = np.where(own >= 0, self.size[own], 0)
        edge = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.start[own] - edge[:-1], size) + np.arange(edge[-1])]
        rows = edge[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [self.whole(odd[k]).tobytes() if k in odd else ids[rows[k] : rows[k + 1]].tobytes() for k in range(len(col))]


_tokenizers: dict[str, WordTokenizer] = {}
KEPT.append(_tokenizers)


def tokenizer(path: str) -> WordTokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class Packer:
    """One partition's windows. A piece is [document, first id, ids]; sizes count ids."""

    def __init__(self, window: int, limit: int):
        self.window, self.limit = window, limit
        self.room: list[tuple[int, int]] = []  # (free ids, number), sorted
        self.open: dict[int, list] = {}
        self.next = 0

    def _take(self, at: int, piece: list) -> Iterator[list]:
        free, number = self.room.pop(at)
        self.open[number].append(piece)
        free -= len(piece[2]) // 4
        if free:
            insort(self.room, (free, number))
        else:
            yield self.open.pop(number)

    def add(self, doc, ids: bytes) -> Iterator[list]:
        """Places a document and yields every window that becomes full."""
        step, start, end = 4 * self.window, 0, len(ids)
        while end - start >= step:
            yield [[doc, start // 4, ids[start : start + step]]]
            start += step
        while start < end:
            size = (end - start) // 4
            at = bisect_left(self.room, (size, -1))
            if at < len(self.room):
                yield from self._take(at, [doc, start // 4, ids[start:]])
                return
            if len(self.room) < self.limit:
                self.open[self.next] = []
                insort(self.room, (self.window, self.next))
                self.next += 1
                continue
            free = 4 * self.room[0][0]
            yield from self._take(0, [doc, start // 4, ids[start : start + free]])
            start += free

    def tail(self) -> Iterator[list]:
        """Joins the open windows, fullest first: full windows, then at most one that is not."""
        left = [p for _, n in sorted(self.room) for p in self.open[n]]
        now, size = [], 0
        for doc, start, ids in left:
            while ids:
                part, ids = ids[: 4 * (self.window - size)], ids[4 * (self.window - size) :]
                now.append([doc, start, part])
                start, size = start + len(part) // 4, size + len(part) // 4
                if size == self.window:
                    yield now
                    now, size = [], 0
        if now:
            yield now


SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, tail boolean, part int"
#: Sequence numbers from here on are those of merged tails.
MERGED = 1 << 62


def _pack(path: str, window: int, limit: int, end_id: int, with_ids: bool, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack, part, number = tokenizer(path), Packer(window, limit), TaskContext.get().partitionId(), 0
        end, rows = np.array([end_id], "<u4").tobytes(), []

        def flush():
            nonlocal rows
            cols = list(zip(*rows, strict=True)) or [()] * 9
            types = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
            out = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            rows = []
            return pa.RecordBatch.from_arrays([*out, pa.array(np.full(len(out[0]), part, np.int32))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "tail", "part"])

        def emit(full: list) -> None:
            nonlocal number
            at, size = 0, sum(len(p[2]) for p in full) // 4
            for (doc, total), start, ids in full:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, part << 32 | number, at, ids if with_ids or size < window else None, size < window))
                at += len(ids) // 4
            number += 1

        for b in batches:
            docs = b.column(0).to_pylist()
            for i, j in chunks(utf8(b.column(1))[1]):
                for doc, ids in zip(docs[i:j], encode(b.column(1).slice(i, j - i)), strict=True):
                    ids += end
                    for full in pack.add((doc, len(ids) // 4), ids):
                        emit(full)
                if len(rows) >= 256:
                    yield flush()
        for full in pack.tail():
            emit(full)
        yield flush()

    return run


def _recut(window: int, total: int, with_ids: bool, id_type: pa.DataType):
    """Cuts pieces of the strung tails at window ends; the last window's bits give the lengths of the last sequences."""
    rest, edges = total % window, [total - total % window]
    while rest:
        edges.append(edges[-1] + (1 << rest.bit_length() - 1))
        rest -= 1 << rest.bit_length() - 1

    def span(at: int) -> tuple[int, int, int]:
        if at < edges[0]:
            return at // window, at // window * window, (at // window + 1) * window
        k = next(i for i in range(len(edges) - 1) if at < edges[i + 1])
        return edges[0] // window + k, edges[k], edges[k + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, start, ids, tokens, at in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                while ids:
                    k, lo, hi = span(at)
                    piece, ids = ids[: 4 * (hi - at)], ids[4 * (hi - at) :]
                    n = len(piece) // 4
                    rows.append((doc, start, n, zlib.crc32(piece), tokens, MERGED + k, at - lo, piece if with_ids else None))
                    start, at = start + n, at + n
            types = [id_type, *[pa.int64()] * 6, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 8, types, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, *, path: str | None = None, window: int = WINDOW, open_windows: int = OPEN, end_id: int = END, with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids (little-endian 32-bit)."""
    path = path or tokenizer_path()
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    first = cut(arrow_map(docs.select("doc_id", "text"), _pack(path, window, open_windows, end_id, with_ids, id_type), SCHEMA.format(id=kind)), "pk-pieces")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    tails = first.filter("tail")
    sizes = tails.groupBy("part").agg(F.sum("length").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"))
    placed = tails.join(before, "part").select("doc_id", "start", "ids", "doc_tokens", (F.col("before") + F.col("offset")).alias("at"))
    merged = arrow_map(placed, _recut(window, total, with_ids, id_type), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return first.filter("not tail").select(*names).unionByName(merged.select(*names))
