"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its hashed words, of their hashed
character n-grams, of hashed pairs of neighbouring words, and of the recency of each
word (how many words ago the same word stood last, in powers of two) and of pairs of
neighbouring recencies, which tell repeated words, phrases and lines whatever they say.
Two softmax outputs on that mean are trained by numpy stochastic gradient descent. Since
the outputs are linear in the mean, each feature's vector is projected on the difference
of the two outputs once after training, and scoring is a lookup and a mean over whole
texts.

Fitting uses at most `sample` labelled documents of at most `sample_bytes` of text in
all (the documented bounds), those with the smallest hash of doc_id among labelled rows
outside the held-out fold; everything else sees all rows. Labels, lang, source and
doc_id are never inputs of a score.

Defined results: a text without words, or null, scores as the mean zero vector (the
bias alone); a document labelled twice is used with both labels, and of the texts of a
repeated doc_id the least is learned from; null labels and null ids are not learned
from; without any labelled row every score is the prior 0.5; a score of just the cut is
kept; an empty table gives no row; texts over a megabyte are read in pieces that end at
a blank, where word pairs and recencies start anew; extra columns are not read.

Scale: the sample's ids are the only broadcast (bounded by `sample`), features of the
sampled documents are counted on the executors, and scoring is a map without shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.llm.common import BLOCK, SPACE, U64, arrow_map, chunks, cut, mix, utf8, word_table

DIM, EPOCHS, RATE, SAMPLE, SEED = 8, 8, 0.35, 4000, 17
SAMPLE_BYTES, SLICES = 64 << 20, 16
CUT = 0.7


_MARK = np.arange(256, dtype=np.uint8)
_MARK[SPACE] = 32


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, features per row) of whole texts, row after row.

    Words, their character n-grams (2 to 4 bytes, a blank marking each end of a word,
    none across words), pairs of words, recencies and pairs of these, numbered by kind.
    """
    starts, lens, h, counts = word_table(data, off, lower=False)
    rows = np.repeat(np.arange(len(counts)), counts)
    parts, owners = [(h % U64(WORDS)).astype(np.int32)], [rows]
    beside = np.flatnonzero(rows[1:] == rows[:-1]) if len(h) else np.zeros(0, np.int64)
    parts.append((mix(h[beside] * U64(0x9E3779B97F4A7C15) + h[beside + 1]) % U64(PAIRS)).astype(np.int32) + 4 * WORDS)
    owners.append(rows[beside])
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero((h[order[1:]] == h[order[:-1]]) & (rows[order[1:]] == rows[order[:-1]]))
    last = np.zeros(len(h), np.int32)
    last[order[same + 1]] = 1 + np.minimum(np.log2(order[same + 1] - order[same]), 14).astype(np.int32)
    parts += [last + (4 * WORDS + PAIRS), 16 + 16 * last[beside] + last[beside + 1] + (4 * WORDS + PAIRS)]
    owners += [rows, rows[beside]]
    # words side by side, one blank between them
    size = int(lens.sum()) + len(lens) + 1
    text = np.full(size, 32, np.uint32)
    inside = np.ones(size, bool)
    ends = np.cumsum(lens + 1)
    inside[0] = False
    inside[ends] = False
    keep = np.zeros(len(data), bool)
    keep = ~SPACE.take(data[off[0] : off[-1]])
    text[inside] = data[off[0] : off[-1]][keep]
    first = np.concatenate([[0], np.cumsum(counts)])
    edge = np.concatenate([[0], ends])[first]  # a row's words lie from here
    for n, base in ((2, WORDS), (3, 2 * WORDS), (4, 3 * WORDS)):
        m = size - n + 1
        if m <= 0:
            continue
        x = np.zeros(m, np.uint32)
        ok = np.ones(m, bool)
        for j in range(n):
            x += text[j : j + m] * _GRAM[n, j]
            if 0 < j < n - 1:
                ok &= inside[j : j + m]
        if n == 2:
            ok &= inside[:m] | inside[1 : 1 + m]
        else:
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x >>= np.uint32(16)
        at = np.flatnonzero(ok)
        parts.append(x[at].astype(np.int32) + base)
        owners.append(np.searchsorted(edge[1:], at, side="right") if len(counts) > 1 else np.zeros(len(at), np.int64))
    return parts, owners


WORDS, PAIRS = 1 << 16, 1 << 17
BUCKETS = 4 * WORDS + PAIRS + 16 * 17
_GRAM = {(2, 0): np.uint32(256), (2, 1): np.uint32(1)} | {(n, j): np.uint32(0x9E3779B1 * (2 * j + 1) + 0x85EBCA6B * n & 0xFFFFFFFF | 1) for n in (3, 4) for j in range(n)}


def pieces(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, offsets) of rows that are handled together: about a megabyte, a longer row in pieces that end at a blank."""
    for i, j in chunks(off):
        if off[j] - off[i] <= 2 * BLOCK:
            yield i, off[i : j + 1]
            continue
        at = int(off[i])
        while at < off[j]:
            to = min(at + BLOCK, int(off[j]))
            while to < off[j] and not SPACE[data[to]]:
                to += 1
            yield i, np.array([at, to])
            at = to


def fold(col: str, parts: int):
    """crc32 of the id as text, modulo parts; a null id falls in part 0."""
    return F.pmod(F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(0)), F.lit(parts))


def _count(batches):
    for b in batches:
        data, off = utf8(b.column(0))
        ids, counts = [], []
        for k in range(b.num_rows):
            found = [f for _, o in pieces(data, off[k : k + 2]) for f in features(data, o)[0]]
            u, c = np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)
            ids.append(u.astype(np.int32))
            counts.append(c.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), b.column(1)], ["ids", "counts", "y"])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Rows (features, counts, label) to (projected feature vectors, bias): score = sigmoid(bias + mean of the features' numbers)."""
    rng = np.random.default_rng(SEED)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    if not rows:
        return np.zeros(BUCKETS, np.float32), 0.0
    steps, at = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            ids, c, y = rows[k]
            w = c.astype(np.float32)
            w /= max(1.0, float(w.sum()))
            rate = RATE * (1 - at / steps)
            at += 1
            v = w @ emb[ids] if len(ids) else np.zeros(DIM, np.float32)
            z = out @ v + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ out
            out -= rate * p[:, None] * v
            bias -= rate * 0.1 * p
            if len(ids):
                # the step is shared by the document's features as they share its mean, scaled to keep rare ones learning
                emb[ids] -= (rate * len(ids) ** 0.5) * w[:, None] * back
    return (emb @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", parts: int = 4, held: int = 2, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", parts) != held))
    ids = ids.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).distinct().orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id"))
    chosen = cut(chosen.groupBy("id", "y").agg(F.min("text").alias("text")), "quality-sample")
    # at most `sample` rows, so one task may number them
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(Window.orderBy(F.xxhash64("id"), "id", "y").rowsBetween(Window.unboundedPreceding, 0))
    chosen = chosen.withColumn("size", size).filter(F.col("size") <= sample_bytes)
    feats = arrow_map(chosen.select("text", F.to_json(F.struct("y", F.xxhash64("id").alias("h"))).alias("k")), _count, "ids array<int>, counts array<int>, y string")
    # a slice at a time, so that the driver never holds all of it twice
    feats, rows = cut(feats, "quality-features"), []
    for part in range(SLICES):
        got = feats.filter(F.pmod(F.crc32(F.col("y").cast("binary")), F.lit(SLICES)) == part).toArrow()
        for r in got.to_batches():
            for i in range(r.num_rows):
                k = json.loads(r.column(2)[i].as_py())
                c = r.column(1)[i].values.to_numpy()
                rows.append((k["h"], k["y"], r.column(0)[i].values.to_numpy().copy(), c.astype(np.uint16 if len(c) and c.max() < 1 << 16 else np.int32)))
        del got
        pa.default_memory_pool().release_unused()
    rows.sort(key=lambda x: (x[0], x[1]))
    return train([(ids, c, 1 if y else 0) for _, y, ids, c in rows])


def scores(data: np.ndarray, off: np.ndarray, model: tuple[np.ndarray, float]) -> np.ndarray:
    """Probability of label 1 for each row."""
    weights, bias = model
    n = len(off) - 1
    total, size = np.zeros(n), np.zeros(n)
    for i, some in pieces(data, off):
        m = len(some) - 1
        for f, rows in zip(*features(data, some), strict=True):
            if len(f):
                total[i : i + m] += np.bincount(rows, weights.take(f), m)
                size[i : i + m] += np.bincount(rows, minlength=m)
    return 1 / (1 + np.exp(-(bias + total / np.maximum(size, 1))))


def score(docs: DataFrame, model: tuple[np.ndarray, float], *, keep: list[str], column: str = "score", at_least: float | None = None) -> DataFrame:
    """The columns `keep` with the score; with at_least, only rows that reach it, and no new column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]
    at = keep.index("text") if "text" in keep else len(keep)

    def run(batches):
        model = shared.value
        for b in batches:
            data, off = utf8(b.column(at))
            got = scores(data, off, model)
            cols = [b.column(k) for k in range(len(keep))]
            if at_least is None:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(got, pa.float64())], [*keep, column])
            else:
                yield pa.RecordBatch.from_arrays(cols, keep).filter(pa.array(got >= at_least))

    src = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if "text" in keep else [F.col("text").alias("__text")]))
    return arrow_map(src, run, T.StructType([*fields, *([T.StructField(column, T.DoubleType())] if at_least is None else [])]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, fit(docs, labels), keep=["doc_id"])
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that score at least the cut, with their columns as they came."""
    return score(docs, fit(docs, labels), keep=docs.columns, at_least=CUT)
