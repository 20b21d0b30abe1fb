"""Shared pieces: the cluster's shared folder, written cuts, and vectorised text."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
BLOCK = 1 << 20
"""Bytes of text handled at once by the vectorised routines."""


# ------------------------------------------------------------------ shared folder
_shipped: set[str] = set()
_runs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stratalake-")
        spark.conf.set("spark.checkpoint.dir", base)
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{base.rstrip('/')}/stratalake-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, _runs[app])
    return _runs[app]


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through Hadoop, so any file system works. Files of a session already ended stay."""
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends here and a lost executor costs only a re-read."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(df: DataFrame) -> None:
    """Removes a cut that nothing reads any more."""
    if path := getattr(df, "_cut_path", None):
        _remove(df.sparkSession, path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so workers can import it wherever they start."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    target = os.path.join(tempfile.mkdtemp(prefix="stratalake-code-"), "stratalake.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


#: What a worker process keeps between partitions of one map, such as a tokenizer.
KEPT: list[dict] = []
_map = {"id": ""}


def begin(this: str) -> None:
    """Where a worker turns to another map, what it kept for the last one goes back to the system."""
    if _map["id"] == this:
        return
    _map["id"] = this
    for kept in KEPT:
        kept.clear()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow. Where the session has Spark's own 10,000 rows a batch, 1,000 are set, as rows are whole texts."""
    ship(df.sparkSession)
    this = uuid.uuid4().hex

    def run(batches):
        begin(this)
        yield from fn(batches)
        # workers are used again, so what this partition's batches took goes back to the system
        pa.default_memory_pool().release_unused()

    if df.sparkSession.conf.get(ROWS) == "10000":
        df.sparkSession.conf.set(ROWS, "1000")
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ text buffers
def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the text; null is empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    buf = col.buffers()[2]
    return (np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)), off


def raw_texts(col: pa.Array) -> list[bytes]:
    """The column's UTF-8 bytes; null is empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    return col.cast(pa.large_binary()).to_pylist()


def chunks(off: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


# ------------------------------------------------------------------ words and their hashes
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


PLACES = 64
_K = U64(0x9E3779B97F4A7C15)
#: A value for each byte at each of a word's first PLACES places; further places are mixed when met.
VALUE = mix((np.arange(256 * PLACES, dtype=np.uint64) + U64(1)) * _K)


def word_table(data: np.ndarray, off: np.ndarray, lower: bool = True, sep: np.ndarray = SPACE):
    """Words of the rows off[i]..off[i+1]: (first byte, length, 64-bit hash, words per row).

    A word's hash sums a mixed value of each byte at its place, so no pattern of bytes
    cancels out as in a polynomial. Blocks end at a separator or a row's end, so memory
    follows the block and not the longest row, but for a word that is longer itself.
    """
    S, L, H = [], [], []
    lo, end = int(off[0]), int(off[-1])
    while lo < end:
        hi = min(lo + BLOCK, end)
        while hi < end and hi != (stop := int(off[np.searchsorted(off, hi)])):
            found = np.flatnonzero(sep[data[hi : min(stop, hi + 65536)]])
            if len(found):
                hi += int(found[0])
                break
            hi = min(stop, hi + 65536)
        seg = data[lo:hi]
        inside = ~sep.take(seg)
        first = np.empty(len(seg), bool)
        first[0] = inside[0]
        np.greater(inside[1:], inside[:-1], out=first[1:])
        last = np.empty(len(seg), bool)
        last[-1] = inside[-1]
        np.greater(inside[:-1], inside[1:], out=last[:-1])
        at = off[np.searchsorted(off, lo) : np.searchsorted(off, hi)] - lo
        first[at] = inside[at]
        at = at[at > 0] - 1
        last[at] = inside[at]
        starts = np.flatnonzero(first)
        if len(starts):
            ends = np.flatnonzero(last)
            lens = ends + 1 - starts
            letters = seg[inside]
            if lower:
                letters = LOWER.take(letters)
            at = np.cumsum(lens) - lens
            kind = np.int32 if len(letters) < 1 << 23 else np.int64
            place = np.arange(len(letters), dtype=kind) - np.repeat(at.astype(kind), lens)
            place <<= 8
            place += letters
            value = VALUE.take(place, mode="clip")
            if lens.max() > PLACES:
                far = np.flatnonzero(place >= 256 * PLACES)
                value[far] = mix((place[far].astype(np.uint64) + U64(1)) * _K)
            H.append(mix(np.add.reduceat(value, at) + lens.astype(np.uint64)))
            S.append(starts + lo)
            L.append(lens)
        lo = hi
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    starts = cat(S, np.int64)
    counts = np.diff(np.searchsorted(starts, off))
    return starts, cat(L, np.int64), cat(H, np.uint64), counts


def i64(x: np.ndarray) -> pa.Array:
    """64-bit hashes as signed longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
