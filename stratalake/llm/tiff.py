"""TIFF columns: walk image directories, decode strips and tiles, undo predictors.

`pages` turns a binary column into one row per image directory. Read are both byte
orders, classic and big files, 1/8/16/32-bit samples, strips and tiles, chunky and
planar layout, no compression, PackBits, LZW and deflate, and the horizontal
predictor. `encode` writes such files.

Defined results: null bytes give no page; bytes that are no TIFF, or a damaged
directory, give one row with `error` set and no pixels, and so does a page whose claimed
size its bytes cannot hold or that is over MOST bytes; empty images have no pixels; an
empty table gives no row; repeated files are read each time; columns asked for with
`keep` come along, others are not read.

Scale: a map without shuffle; a task holds one file and its pages at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.llm.common import arrow_map, raw_texts

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
# fixed values: TIFF field types and their sizes
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}


# ------------------------------------------------------------------ codecs
def unpackbits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def packbits(data: bytes) -> bytes:
    """Runs of three bytes or more as runs, all between them as literals."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    runs = np.diff(edge, append=len(a))
    long = np.flatnonzero(runs > 2)
    out, done = bytearray(), 0
    for at, n in [*zip(edge[long].tolist(), runs[long].tolist(), strict=True), (len(a), 0)]:
        for k in range(done, at, 128):
            out.append(min(at, k + 128) - k - 1)
            out += data[k : min(at, k + 128)]
        done = at + n
        while n:
            k = min(n, 128)
            out += bytes([257 - k if k > 1 else 0, data[at]])
            n -= k
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    """Most significant bit first, code width grows one code early, 256 clears and 257 ends."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, width, prev, have = list(base), [], 9, None, 0
    buf = bits = 0
    for byte in data:
        buf, bits = buf << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, buf = buf >> bits, buf & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, prev = list(base), 9, None
            continue
        if prev is None:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError(f"LZW code {code} stands before its entry")
            entry = table[code] if code < len(table) else prev + prev[:1]
            table.append(prev + entry[:1])
        out.append(entry)
        have += len(entry)
        prev = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        if have >= size:
            break
    return b"".join(out)[:size]


def lzw(data: bytes) -> bytes:
    table, width, nxt = {bytes([i]): i for i in range(256)}, 9, 258
    buf, bits, out = 256, 9, bytearray()

    def put(code: int):
        nonlocal buf, bits
        buf, bits = buf << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(buf >> bits)
            buf &= (1 << bits) - 1

    bits -= 8
    out.append(buf >> bits)
    buf &= (1 << bits) - 1
    cur = b""
    for i in range(len(data)):
        c = data[i : i + 1]
        if cur + c in table:
            cur += c
            continue
        put(table[cur])
        table[cur + c] = nxt
        nxt += 1
        if nxt > 4093:
            put(256)
            table, width, nxt = {bytes([k]): k for k in range(256)}, 9, 258
        else:
            width = 9 if nxt < 512 else 10 if nxt < 1024 else 11 if nxt < 2048 else 12
        cur = c
    if cur:
        put(table[cur])
        nxt += 1
        width = 9 if nxt < 512 else 10 if nxt < 1024 else 11 if nxt < 2048 else 12
    put(257)
    if bits:
        out.append(buf << 8 - bits & 255)
    return bytes(out)


DECODE = {NONE: lambda d, n: d[:n], LZW: unlzw, PACKBITS: unpackbits, DEFLATE: lambda d, n: zlib.decompressobj().decompress(d, n), 32946: lambda d, n: zlib.decompressobj().decompress(d, n)}
ENCODE = {NONE: bytes, LZW: lzw, PACKBITS: packbits, DEFLATE: lambda d: zlib.compress(d, 1)}


#: The most bytes that one stored byte can stand for.
GROWTH = {NONE: 1, PACKBITS: 64, LZW: 3700, DEFLATE: 1040, 32946: 1040}
MOST = 1 << 30
"""Bytes of one page's pixels; a larger page gives an error row (a binary value ends at 2 GB)."""


# ------------------------------------------------------------------ directories
def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The tags of each image directory, in file order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order:
        raise ValueError("not a TIFF: no byte order")
    version = struct.unpack_from(order + "H", data, 2)[0]
    if version == 42:
        at, count, entry, ptr, inline = struct.unpack_from(order + "I", data, 4)[0], "H", "HHI", "I", 4
    elif version == 43:
        at, count, entry, ptr, inline = struct.unpack_from(order + "Q", data, 8)[0], "Q", "HHQ", "Q", 8
    else:
        raise ValueError(f"not a TIFF: version {version}")
    seen = set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        n = struct.unpack_from(order + count, data, at)[0]
        at += struct.calcsize(count)
        tags = {None: order}
        for _ in range(n):
            tag, kind, k = struct.unpack_from(order + entry, data, at)
            at += struct.calcsize("<" + entry)
            if code := TYPES.get(kind):
                fmt = f"{order}{k}{code}"
                where = at if struct.calcsize(fmt) <= inline else struct.unpack_from(order + ptr, data, at)[0]
                tags[tag] = struct.unpack_from(fmt, data, where)
            at += inline
        yield tags
        at = struct.unpack_from(order + ptr, data, at)[0]


def decode(data: bytes, tags: dict[int, tuple]) -> tuple[np.ndarray, int, int, int, int]:
    """(samples as height x width x samples, width, height, samples, bits) of one directory."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, bits, spp = one(256, 0), one(257, 0), one(258, 1), one(277, 1)
    packing, predictor, planar, order = one(259, NONE), one(317, 1), one(284, 1), tags[None]
    if packing not in DECODE:
        raise ValueError(f"compression {packing} is not read")
    if predictor not in (1, 2) or bits not in (1, 8, 16, 32):
        raise ValueError(f"predictor {predictor} with {bits} bits is not read")
    tiled = 322 in tags
    w, h = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height), height) or height)
    offsets, counts = (tags[324], tags[325]) if tiled else (tags.get(273, ()), tags.get(279, ()))
    if any(x != bits for x in tags.get(258, ())) or spp < 1:
        raise ValueError("samples of several sizes, or none, are not read")
    if width < 1 or height < 1:
        return np.zeros((max(0, height), max(0, width), 1), np.uint8)[:0], width, height, spp, bits
    if w < 1 or h < 1:
        raise ValueError(f"blocks of {w} x {h}")
    # what the file claims is held against its bytes before anything is allocated
    size = height * ((width * spp * bits + 7) // 8)
    if size > MOST or size > GROWTH[packing] * min(len(data), sum(counts)):
        raise ValueError(f"{width} x {height} x {spp} of {bits} bits do not fit in {len(data)} bytes")
    kind = np.dtype(np.uint8 if bits == 1 else f"u{bits // 8}").newbyteorder(order)
    planes, inner = (spp, 1) if planar == 2 else (1, spp)
    out = np.zeros((height, width, spp), kind.newbyteorder("="))
    across, down = -(-width // w), -(-height // h)
    if len(offsets) != across * down * planes:
        raise ValueError(f"{len(offsets)} blocks where {across * down * planes} belong")
    for k, (at, size) in enumerate(zip(offsets, counts, strict=True)):
        plane, cell = divmod(k, across * down)
        y, x = cell // across * h, cell % across * w
        rows = h if tiled else min(h, height - y)
        row = (w * inner * bits + 7) // 8
        if row * rows > GROWTH[packing] * size:
            raise ValueError(f"block {k} is too short")
        raw = DECODE[packing](data[at : at + size], row * rows)
        if len(raw) < row * rows:
            raise ValueError(f"block {k} holds {len(raw)} of {row * rows} bytes")
        if bits == 1:
            block = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, row), axis=1)[:, : w * inner]
        else:
            block = np.frombuffer(raw, kind).reshape(rows, w * inner)
        block = block.reshape(rows, w, inner).astype(kind.newbyteorder("="), copy=False)
        if predictor == 2:
            block = np.add.accumulate(block, axis=1, dtype=block.dtype)
        rows, cols = min(rows, height - y), min(w, width - x)
        out[y : y + rows, x : x + cols, plane if planes > 1 else slice(None)] = block[:rows, :cols, 0 if planes > 1 else slice(None)]
    return out, width, height, spp, bits


def encode(images: Sequence[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, strip_bytes: int = 1 << 16, order: str = "<") -> bytes:
    """A classic TIFF of 8- or 16-bit images (height x width or height x width x samples), one directory each."""
    out, link = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0)), 4
    for image in images:
        a = image.reshape(*image.shape[:2], -1)
        height, width, spp = a.shape
        rows = max(1, strip_bytes // max(1, width * spp * a.itemsize))
        cells = [(y, x) for y in range(0, height, tile or rows) for x in (range(0, width, tile) if tile else (0,))]
        offsets, sizes = [], []
        for y, x in cells:
            block = a[y : y + (tile or rows), x : x + tile] if tile else a[y : y + rows]
            if tile:
                block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1]), (0, 0)))
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
            packed = ENCODE[compression](block.astype(block.dtype.newbyteorder(order)).tobytes())
            offsets.append(len(out))
            sizes.append(len(packed))
            out += packed
        out += b"\0" * (len(out) % 2)
        tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [a.itemsize * 8] * spp), (259, 3, [compression]), (262, 3, [2 if spp == 3 else 1]), (277, 3, [spp]), (317, 3, [predictor])]
        tags += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, offsets), (325, 4, sizes)] if tile else [(273, 4, offsets), (278, 4, [rows]), (279, 4, sizes)]
        entries = []
        for tag, kind, values in sorted(tags):
            body = struct.pack(f"{order}{len(values)}{TYPES[kind]}", *values)
            if len(body) > 4:
                entries.append(struct.pack(order + "HHII", tag, kind, len(values), len(out)))
                out += body + b"\0" * (len(body) % 2)
            else:
                entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


# ------------------------------------------------------------------ columns
PAGE = "page int, width long, height long, samples int, bits int, pixels binary, error string"


def pages(df: DataFrame, column: str = "media", keep: Sequence[str] = ()) -> DataFrame:
    """One row per image directory of `column`, with the columns `keep`."""
    schema = T.StructType([*[df.schema[c] for c in keep], *T._parse_datatype_string(PAGE)])

    def run(batches):
        names = [*keep, "page", "width", "height", "samples", "bits", "pixels", "error"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        for b in batches:
            at, rows = [], []
            size = 0
            for i in range(b.num_rows):
                data = b.column(0)[i].as_py()
                for row in _walk(data) if data is not None else ():
                    at.append(i)
                    rows.append(row)
                    size += len(row[5] or b"")
                if size > 1 << 23 or i == b.num_rows - 1:
                    idx = pa.array(at, pa.int64())
                    cols = [b.column(k + 1).take(idx) for k in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*cols, *[pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 7, types, strict=True)]], names)
                    at, rows, size = [], [], 0

    return arrow_map(df.select(F.col(f"`{column}`").alias("__media"), *[F.col(f"`{c}`") for c in keep]), run, schema)


DAMAGE = (ValueError, TypeError, LookupError, ArithmeticError, MemoryError, struct.error, zlib.error)
"""What a damaged file can raise; anything else is a fault of this code."""


def _walk(data: bytes) -> Iterator[tuple]:
    k, it = 0, None
    try:
        it = directories(data)
        for k, tags in enumerate(it):  # noqa: B007
            try:
                a, width, height, spp, bits = decode(data, tags)
                yield k, width, height, spp, bits, a.tobytes(), None
            except DAMAGE as e:
                yield k, None, None, None, None, None, f"{type(e).__name__}: {e}"
            k += 1
    except DAMAGE as e:
        yield k, None, None, None, None, None, f"{type(e).__name__}: {e}"


ROW, PAGE_ROWS = 64, 4096
#: Stored forms (compression, predictor, tile, pages at least), chosen by the payload's checksum.
FORMS = [(DEFLATE, 2, 0, 1)] * 9 + [(DEFLATE, 1, 32, 2), (PACKBITS, 1, 0, 1), (PACKBITS, 2, 16, 1), (NONE, 1, 0, 2), (NONE, 2, 32, 1), (LZW, 1, 0, 1), (LZW, 2, 0, 2)]


def stored(payload: bytes) -> bytes:
    """A payload of whole rows as a grey 8-bit TIFF of one page per PAGE_ROWS rows, or more."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    compression, predictor, tile, least = FORMS[zlib.crc32(payload) % len(FORMS)]
    n = min(len(a), max(least, -(-len(a) // PAGE_ROWS)))
    return encode(np.array_split(a, n), compression, predictor, tile)


def store(docs: DataFrame) -> DataFrame:
    """Each text as grey 8-bit images 64 wide, zero padded to whole rows: doc_id, n_bytes, media."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                texts = raw_texts(b.column(1).slice(i, 256))
                media = [stored(t.ljust(max(ROW, -(-len(t) // ROW) * ROW), b"\0")) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 256), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, media binary")


def fingerprint(media: DataFrame) -> DataFrame:
    """Adds media_bytes and media_sha256, the stored form's size and digest."""
    return media.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))


def digests(df: DataFrame) -> DataFrame:
    """The contract's columns from decoded pages, which come document by document, in page order.

    df: doc_id, n_bytes, page, pixels, and media or its fingerprint. The feature counts
    the sixteen grey bands, after rows x columns.
    """
    names = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]

    def run(batches):
        now, rows = None, []

        def close():
            doc, n, size, sha, total, digest, tail, bands = now
            rows.append((doc, n, total, digest.hexdigest(), zlib.crc32(tail), size, sha, f"{total // ROW}x{ROW}:" + ",".join(map(str, bands.tolist()))))

        def flush():
            types = [kind, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 8, types, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

        kind = pa.int64()
        for b in batches:
            kind = b.schema.field(0).type
            head, page = [b.column(i).to_pylist() for i in range(4)], b.column(4).to_pylist()
            for i in range(b.num_rows):
                if page[i] == 0:
                    if now:
                        close()
                    now = [*(c[i] for c in head), 0, hashlib.sha256(), b"", np.zeros(16, np.int64)]
                pixels = b.column(5)[i].as_py() or b""
                now[4] += len(pixels)
                now[5].update(pixels)
                now[6] = (now[6] + pixels[-ROW:])[-ROW:]
                now[7] += np.bincount(np.frombuffer(pixels, np.uint8) >> 4, minlength=16)
            yield flush()
        if now:
            close()
            yield flush()

    if "media" in df.columns:
        df = fingerprint(df)
    kind = dict(df.select("doc_id").dtypes)["doc_id"]
    return arrow_map(df.select(*names, "page", "pixels"), run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
