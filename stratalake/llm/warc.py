"""WARC archives: written by the executors, indexed first, then read by coalesced ranges.

`write` puts one record per page into archives in the shared folder (one or more per
partition, rolled at `roll` bytes), each record a gzip member of its own: a response
with the payload, or a revisit that names the response with the same payload.
`index` walks the archives member by member and gives offset, length, URL and digest
of every record; payloads are not kept. `fetch` sorts the chosen records by archive
and offset, joins ranges that lie close together, and reads each joined range once.

Defined results: null html is an empty payload; payloads under `least` bytes are
always responses; a null page_id is written and read as null, is never referred to
and never refers; the smallest page_id is the response, and a page_id that repeats
is written once per row; URLs come back as they were: one with characters that a header
cannot hold is percent-encoded in its target line and stands whole in a line of its own,
and a null URL has an empty target; an empty table gives no archive; extra columns are
not read.

Scale: a copy that follows a smaller page_id in its task drops its body at once; page
ids and digests alone meet on the digest, salted, so a page copied a million times is no
hot key; its reference comes back to the row by page id (the bodies left are shuffled
for that where the references are too many to broadcast); archive files replace a half-written attempt by one rename; a fetch task holds one
joined range of at most `most` bytes or one record.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.common import arrow_map, cut, raw_texts, scratch

LEAST, ROLL, GAP, MOST = 100, 256 << 20, 64 << 10, 8 << 20
DATE = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, digest: str, size: int, body: bytes, refers: int | None) -> bytes:
    """One record with its closing blank lines."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response" if refers is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=_SAFE)}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None and (not url or quote(url, safe=_SAFE) != url):
        head.append(f"{EXACT}: {quote(url)}")
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}", "", ""]
    return "\r\n".join(head).encode() + http + body + b"\r\n\r\n"


_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%") + "%"


EXACT = "X-Target-Quoted"
"""A line with the whole URL, every odd character and % quoted, where the target line differs from it."""
GZIP = 31
"""zlib's window bits of a gzip member."""


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, GZIP)
    return z.compress(data) + z.flush()


def members(f, head: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, first bytes) of each member of an open archive, a part at a time."""
    at, rest = 0, f.read(1 << 18)
    while rest:
        z, size, text = zlib.decompressobj(GZIP), 0, b""
        while True:
            size += len(rest)
            out = z.decompress(rest)
            # headers stand at the start; of a payload no more than one part is held
            if len(text) < head or text.count(b"\r\n\r\n") < 2:
                text += out
            if z.eof:
                break
            if not (rest := f.read(1 << 18)):
                raise ValueError(f"the member at {at} has no end")
        rest = z.unused_data
        size -= len(rest)
        yield at, size, text
        at += size
        rest = rest or f.read(1 << 18)


def _fs(path: str):
    return pafs.FileSystem.from_uri(path)


SALTS = 64


def references(seen: DataFrame) -> DataFrame:
    """(copy, of, first): each page id whose payload a smaller one has, by digest."""
    seen = seen.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    some = seen.groupBy("digest", "salt").agg(F.min("page_id").alias("least"), F.max("page_id").alias("most"))
    firsts = some.groupBy("digest").agg(F.min("least").alias("first"), F.max("most").alias("last")).filter("first < last").select(F.col("digest").alias("of"), "first")
    some = some.join(firsts, F.col("digest") == F.col("of")).select("of", F.col("salt").alias("s"), "first")
    found = seen.join(some, (F.col("digest") == F.col("of")) & (F.col("salt") == F.col("s"))).filter("page_id > first")
    return found.select(F.col("page_id").alias("copy"), "of", "first").distinct()


def _lean(least: int, most: int = 200_000):
    """Digests of the bodies; a body whose equal came before with a smaller page id is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smallest: dict[bytes, int] = {}
        for b in batches:
            bodies, digests, sizes = raw_texts(b.column(2)), [], []
            for k, (page, body) in enumerate(zip(b.column(0).to_pylist(), bodies, strict=True)):
                d = hashlib.sha256(body)
                digests.append(d.hexdigest())
                sizes.append(len(body))
                if page is not None and len(body) >= least:
                    if smallest.get(d.digest(), page) < page:
                        bodies[k] = None
                    else:
                        smallest[d.digest()] = page
            if len(smallest) > most:
                smallest.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary())], ["page_id", "url", "digest", "size", "body"])

    return run


def write(pages: DataFrame, *, least: int = LEAST, roll: int = ROLL) -> DataFrame:
    """Writes the archives; a row per archive: path, records, bytes."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    seen = rows.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").alias("size"))
    refers = references(seen.filter((F.col("size") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest"))
    rows = arrow_map(rows, _lean(least), "page_id long, url string, digest string, size long, body binary")
    # rows that cannot refer have keys of their own, so none of them meet
    can = (F.col("size") >= least) & F.col("page_id").isNotNull()
    rows = rows.select("*", F.when(can, F.col("page_id")).otherwise(-1 - F.monotonically_increasing_id()).alias("k"), F.when(can, F.col("digest")).alias("kd"))
    rows = rows.join(refers, (F.col("k") == F.col("copy")) & (F.col("kd") == F.col("of")), "left").select("page_id", "url", "digest", "size", "body", "first")
    # an archive's bytes must not depend on the order in which rows arrive
    rows = rows.sortWithinPartitions("page_id", "digest", "url")
    folder = scratch(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        part, serial, out, done = TaskContext.get().partitionId(), 0, None, []

        def open_():
            name = f"{root}/part-{part:05d}-{serial:04d}.warc.gz"
            temp = f"{root}/.{part}-{serial}-{uuid.uuid4().hex}"
            return name, temp, fs.open_output_stream(temp)

        def close(name, temp, stream, count, size):
            stream.close()
            fs.move(temp, name)
            done.append((f"{folder}/{name.rsplit('/', 1)[1]}", count, size))

        count = size = 0
        for b in batches:
            ids, urls, digests, sizes, refs = (b.column(i).to_pylist() for i in (0, 1, 2, 3, 5))
            for k, body in enumerate(b.column(4).to_pylist()):
                if out is None:
                    out, count, size = open_(), 0, 0
                data = member(record(ids[k], urls[k], digests[k], sizes[k], b"" if refs[k] is not None else body, refs[k]))
                out[2].write(data)
                count, size = count + 1, size + len(data)
                if size >= roll:
                    close(*out, count, size)
                    out, serial = None, serial + 1
        if out is not None:
            close(*out, count, size)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in done], pa.string()), pa.array([n for _, n, _ in done], pa.int64()), pa.array([s for _, _, s in done], pa.int64())], ["path", "records", "bytes"])

    return cut(arrow_map(rows, run, "path string, records long, bytes long"), "warc-files")


def headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:]) if k}


def _page(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(name) if name.lstrip("-").isdigit() else None


INDEX = "path string, offset long, length long, url string, digest string, record_type string, page_id long, refers_to long, payload_bytes long, payload_at long"


def index(files: DataFrame) -> DataFrame:
    """A row per record: its archive, offset and length, URL, digest, type, and where its payload lies."""
    n = max(1, min(files.count(), 4 * files.sparkSession.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                fs, local = _fs(path)
                with fs.open_input_file(local) as f:
                    for at, length, block in members(f):
                        k = block.index(b"\r\n\r\n")
                        h = block.index(b"\r\n\r\n", k + 4)
                        warc, http = headers(block[:k]), headers(block[k + 4 : h])
                        rows.append((path, at, length, unquote(warc[EXACT.lower()]) if EXACT.lower() in warc else warc["warc-target-uri"] or None, warc["warc-payload-digest"].removeprefix("sha256:"), warc["warc-type"], _page(warc["warc-record-id"]), _page(warc.get("warc-refers-to")), int(http["content-length"]), h + 4))
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 10, types, strict=True)], [x.split()[0] for x in INDEX.split(", ")])

    return arrow_map(files.select("path").repartition(n, "path"), run, INDEX)


def joined(ranges: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) ranges as reads: (offset, length, number of ranges)."""
    out: list[list[int]] = []
    for at, n in ranges:
        if out and at - (out[-1][0] + out[-1][1]) <= gap and at + n - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], at + n - out[-1][0])
            out[-1][2] += 1
        else:
            out.append([at, n, 1])
    return [tuple(x) for x in out]


def fetch(chosen: DataFrame, *, gap: int = GAP, most: int = MOST) -> DataFrame:
    """Rows of the index with `payload`, read by joined ranges in archive order."""
    n = int(chosen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = chosen.repartition(n, "path", F.floor(F.col("offset") / (4 * most))).sortWithinPartitions("path", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            path, at, size, body = (b.column(i).to_pylist() for i in (0, 1, 2, 9))
            i = 0
            while i < len(path):
                j = i
                while j < len(path) and path[j] == path[i]:
                    j += 1
                fs, local = _fs(path[i])
                with fs.open_input_file(local) as f:
                    k = i
                    for start, length, count in joined(list(zip(at[i:j], size[i:j], strict=True)), gap, most):
                        data = f.read_at(length, start)
                        got = [zlib.decompress(data[at[x] - start : at[x] - start + size[x]], GZIP)[body[x] : -4] for x in range(k, k + count)]
                        yield pa.RecordBatch.from_arrays([*b.slice(k, count).columns, pa.array(got, pa.binary())], [*b.schema.names, "payload"])
                        k += count
                i = j

    return arrow_map(rows, run, INDEX + ", payload binary")


def report(pages: DataFrame) -> DataFrame:
    """Writes the archives, reads them back, and gives the contract's row per page."""
    idx = cut(index(write(pages)), "warc-index")
    full = fetch(idx.filter("record_type = 'response'"))
    answers = full.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = idx.filter("record_type = 'revisit'").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    return answers.unionByName(again)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, payload_bytes, d.payload_digest,
       CASE WHEN first IS NOT NULL AND first <> d.page_id AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> d.page_id AND payload_bytes >= 100 THEN first END AS refers_to
FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest
"""
