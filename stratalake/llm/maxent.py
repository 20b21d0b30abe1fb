"""Language-model scores from a hashed maximum-entropy model.

P(token | history) = P(class | history) * P(token | class, history), both softmaxes.

The class factor has hashed features of the history: the previous token, the token
before it (a skip feature) and the pair of both. Its weights start from the counts of
class by feature (whole sums, so they do not hang on how the rows are dealt out) and
are trained by distributed gradient updates: every partition runs minibatch gradient
steps in numpy over its share of the text, and the results are averaged by token count
through a tree of sums.

The token factor has a bias for each token (smoothed counts), a feature for each pair of
previous token and token, and one for each triple of the two tokens before and the token,
all hashed and as many as training holds. A feature's constraint is its count in training
less a discount, which keeps mass for what was not seen; with these constraints a
class's softmax over one history has its maximum in closed form, first for the pairs,
then for the triples on top of them: the weight of a seen feature is the log of its
share over the token's probability without it, and all unseen tokens of the class share
one normaliser. So each history's parameters come from its own counts alone, and
histories are dealt out by hash to shards of about SHARD tokens; the more text, the more
shards and features. Tokens go to their shards packed, and a shard returns one sum for
each document. Previous tokens that stand more than SHARD times are split by the token
before them, and pairs of more than half of SHARD by document, so no shard grows with one
history. Their counts are taken of the whole training text beforehand, in a table for
each such token and each such pair, and go to every part, so all parts have the same weights.

Classes: the end token; clusters of the commonest tokens by the company they keep; and
for all other tokens eight shapes (ending in punctuation, holding non-ASCII, holding
digits or signs). Every shape keeps one slot for unknown tokens, as the base does, so
all probabilities sum to one. Tokens beyond the `hot` commonest have no features of
their own; they share what their class leaves unseen.

Counts, company statistics, gradient steps and features see every training document.
Tokens are 61-bit hashes with their shape in the low three bits. The commonest `hot`
tokens are broadcast (a fixed size); the counts of all others reach their documents
through a join on the token.

Defined results: null text is empty (one end token); null ids fall in fold 0 and so
in training; repeated rows count as often as they stand there and score alike; ties among the
commonest tokens go by hash; without training rows N = V = 0 and every score follows
the same formulas; an empty table gives no row; long texts are read in blocks; extra
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.common import LOWER, U64, arrow_map, chunks, cut, i64, mix, utf8, word_table
from stratalake.llm.quality import fold

PARTS, HELD = 7, 2
HOT, CLUSTERED, COMPANY, CLUSTERS, SHAPES = 1 << 18, 6144, 40, 23, 8
CLASSES = 1 + CLUSTERS + SHAPES
BUCKETS, FEATURES = 4096, 3
BATCH, ROUNDS, RATE = 16384, 1, 0.2
SHARD, CHUNK = 1 << 19, 1 << 20
DISCOUNT, DISCOUNT3 = 0.7, 0.6
PRIOR, SHARE = 20.0, 0.5
END = U64(0x5E0D00000000E0D0)
START = U64(0x57A2700000000001)

_KIND = np.zeros(256, np.uint8)  # bit 0: not ASCII; bit 1: neither letter nor mark of punctuation
_KIND[128:] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalpha() and chr(b) not in ".,;:!?'"]] = 2
_STOP = np.zeros(256, np.uint8)
_STOP[[ord(c) for c in ".,;:!?"]] = 4


class Tokens:
    """Tokens of some rows, each row closed by the end token: hashes, shapes, rows and the two tokens before each."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        starts, lens, h, counts = word_table(data, off)
        n = counts + 1
        ends = np.cumsum(n) - 1
        size = int(n.sum())
        self.counts, self.ends = n, ends
        word = np.ones(size, bool)
        word[ends] = False
        self.h = np.full(size, END, np.uint64)
        if len(h):
            lo, hi = int(off[0]), int(off[-1])
            kind = _KIND.take(data[lo:hi])
            shape = np.bitwise_or.reduceat(kind, starts - lo) | _STOP.take(data[starts + lens - 1])
            self.h[word] = h & U64(0xFFFFFFFFFFFFFFF8) | shape.astype(np.uint64)
        self.first = np.concatenate([[0], ends[:-1] + 1]) if size else np.zeros(0, np.int64)

    def before(self, x: np.ndarray, pad) -> np.ndarray:
        """x one token earlier; pad at the start of each row."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first] = pad
        return out


def shapes(h: np.ndarray) -> np.ndarray:
    return (h & U64(7)).astype(np.int16)


def _text_chunks(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, int, int, Tokens]]:
    for b in batches:
        data, off = utf8(b.column(column))
        for i, j in chunks(off):
            yield b, i, j, Tokens(data, off[i : j + 1])


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Makes one of several pairs of values and counts."""
    h, c = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    held[:] = [(h[first], np.add.reduceat(c, first))]


def _count(batches):
    """Counts of a partition's tokens, merged as they come; what it holds follows its distinct tokens."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def rows():
        _merge(held)
        u, c = held.pop()
        for i in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_arrays([i64(u[i : i + 100_000]), pa.array(c[i : i + 100_000])], ["tok", "c"])

    for _, _, _, t in _text_chunks(batches):
        held.append(np.unique(t.h, return_counts=True))
        if len(held) > 16:
            _merge(held)
            if len(held[0][0]) > 1_000_000:
                yield from rows()
    if held:
        yield from rows()


# ------------------------------------------------------------------ sums of arrays over partitions
def tree_sum(df: DataFrame, fn, size: int, dtype: str, fan: int = 8) -> np.ndarray:
    """The sum over partitions of the array that fn makes of each partition's batches."""

    def leaf(batches):
        if (x := fn(batches)) is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([zlib.compress(x.astype(dtype).tobytes(), 1)], pa.binary())], ["k", "x"])

    def add(batches):
        total, k = np.zeros(size, dtype), -1
        for b in batches:
            for i in range(b.num_rows):
                total += np.frombuffer(zlib.decompress(b.column(1)[i].as_py()), dtype)
                k = max(k, b.column(0)[i].as_py())
        if k >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["k", "x"])

    parts = cut(arrow_map(df, leaf, "k int, x binary"), "lm-sums", "none")
    n = parts.count()
    while n > fan:
        n = -(-n // fan)
        parts = arrow_map(parts.repartition(n, F.pmod("k", F.lit(n))), add, "k int, x binary")
        if n > fan:
            parts = cut(parts, "lm-sums", "none")
    total = np.zeros(size, dtype)
    for r in parts.toLocalIterator():
        total += np.frombuffer(zlib.decompress(bytes(r["x"])), dtype)
    return total


# ------------------------------------------------------------------ vocabulary
class Vocabulary:
    """The commonest tokens: hash -> (count, class), found through a direct table of their leading bits."""

    BITS = 22

    def __init__(self, h: np.ndarray, c: np.ndarray):
        order = np.argsort(h)
        self.h, self.c = h[order], c[order].astype(np.float64)
        self.cls = 1 + CLUSTERS + shapes(self.h)
        self.cls[self.h == END] = 0
        self.rank = np.argsort(np.lexsort((self.h, -self.c)))
        self._lay()

    def _lay(self) -> None:
        self.table = np.zeros(1 << self.BITS, np.int32)
        self.table[(self.h >> U64(64 - self.BITS)).astype(np.int64)] = np.arange(len(self.h))

    def __getstate__(self):
        return {"h": self.h, "c": self.c.astype(np.int64), "cls": self.cls.astype(np.int8)}

    def __setstate__(self, given):
        self.h, self.c, self.cls = given["h"], given["c"].astype(np.float64), given["cls"].astype(np.int16)
        self._lay()

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of tokens; -1 where they are not among these."""
        if not len(self.h):
            return np.full(len(h), -1, np.int32)
        at = self.table[(h >> U64(64 - self.BITS)).astype(np.int64)]
        rest = np.flatnonzero(self.h[at] != h)
        if len(rest):
            k = np.minimum(np.searchsorted(self.h, h[rest]), len(self.h) - 1)
            at[rest] = np.where(self.h[k] == h[rest], k, -1)
        return at


def cluster(profile: np.ndarray, weight: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """k-means on square roots of company shares, started from the weightiest rows far from each other."""
    x = np.sqrt(profile / np.maximum(1, profile.sum(axis=1, keepdims=True)))
    w = np.sqrt(weight)
    centre = [x[int(np.argmax(w))]]
    far = np.full(len(x), np.inf)
    for _ in range(k - 1):
        far = np.minimum(far, ((x - centre[-1]) ** 2).sum(axis=1))
        centre.append(x[int(np.argmax(far * w))])
    c = np.array(centre)
    for _ in range(rounds):
        own = np.argmin((c**2).sum(axis=1) - 2 * x @ c.T, axis=1)
        for i in range(k):
            if (m := own == i).any():
                c[i] = np.average(x[m], axis=0, weights=weight[m])
    return own


def features(t: Tokens) -> np.ndarray:
    """Rows of the weight table for each token: previous, skip and pair."""
    a = t.before(t.h, START)
    b = t.before(a, START)
    with np.errstate(over="ignore"):
        f = np.stack([mix(a), mix(b + U64(3)), mix(a * U64(0x9E3779B97F4A7C15) + b)])
    return (f % U64(BUCKETS)).astype(np.int32) + (np.arange(FEATURES, dtype=np.int32) * BUCKETS)[:, None]


_ones = np.ones((CLASSES, 1), np.float32)


def softmax(w: np.ndarray, bias: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, their exponentials, sums of these) of each history."""
    z = w.take(f[0], axis=0)
    for k in range(1, FEATURES):
        z += w.take(f[k], axis=0)
    z += bias
    np.minimum(z, 80, out=z)
    e = np.exp(z)
    return z, e, e @ _ones


def classes_of(v: Vocabulary, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    at = v.find(t.h)
    cls = np.where(at >= 0, v.cls[at] if len(v.h) else 0, 1 + CLUSTERS + shapes(t.h))
    cls[t.h == END] = 0
    return at, cls


def _train(shared):
    """Minibatch steps (row-wise adaptive); weights times tokens, then tokens."""

    def run(batches):
        v, w0, b0 = shared.value
        w, bias, g, gb, n = w0.copy(), b0.copy(), np.full(len(w0), 1e-2, np.float32), np.float32(1e-2), 0
        for _, _, _, t in _text_chunks(batches):
            f, (_, cls) = features(t), classes_of(v, t)
            for i in range(0, len(cls), BATCH):
                fi, y = f[:, i : i + BATCH], cls[i : i + BATCH]
                _, p, total = softmax(w, bias, fi)
                p /= total
                p[np.arange(len(y)), y] -= 1
                p /= np.float32(len(y))
                step = p.sum(axis=0)
                gb += np.float32((step**2).sum())
                bias -= RATE / np.sqrt(gb) * step
                for k, x in enumerate(fi):
                    low = (x - k * BUCKETS).astype(np.uint16)
                    order = np.argsort(low, kind="stable")
                    low = low[order]
                    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
                    step, rows = np.add.reduceat(p.take(order, axis=0), first, axis=0), low[first].astype(np.int32) + k * BUCKETS
                    g[rows] += np.square(step) @ _ones[:, 0]
                    w[rows] -= (RATE / np.sqrt(g[rows]))[:, None] * step
            n += len(cls)
        if n:
            return np.concatenate([w.ravel() * n, bias * n, [n]])
        return None

    return run


def _start(shared):
    """Counts of class by feature."""

    def run(batches):
        v = shared.value
        out = np.zeros(FEATURES * BUCKETS * CLASSES, np.int64)
        for _, _, _, t in _text_chunks(batches):
            _, cls = classes_of(v, t)
            for f in features(t):
                out += np.bincount(f.astype(np.int64) * CLASSES + cls, minlength=len(out))
        return out

    return run


def fit(docs: DataFrame, *, rounds: int = ROUNDS):
    """(counts table, totals, vocabulary, weights, bias, class logs) from rows outside the held-out fold."""
    spark = docs.sparkSession
    texts = docs.filter(fold("doc_id", PARTS) != HELD).select("text")
    counts = cut(arrow_map(texts, _count, "tok long, c long").groupBy("tok").agg(F.sum("c").alias("c")), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the commonest tokens: whole steps of a logarithmic scale of counts, from the top, up to HOT tokens
    step = F.floor(F.log(F.col("c")) * 64)
    sizes = sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect(), reverse=True)
    least, have = 1 << 40, 0
    for s, n in sizes:
        if have + n > HOT:
            break
        least, have = s, have + n
    hot = counts.filter(step >= least).toArrow()
    v = Vocabulary(hot["tok"].to_numpy().astype(np.int64).view(np.uint64), hot["c"].to_numpy().astype(np.int64))

    # clusters of the commonest tokens, by the tokens before and after them
    many = v.rank < CLUSTERED
    many[v.h == END] = False
    row = np.full(len(v.h) + 1, -1, np.int32)
    row[:-1][many] = np.arange(many.sum())
    col = np.full(len(v.h) + 1, -1, np.int32)
    col[:-1][v.rank < COMPANY] = np.arange((v.rank < COMPANY).sum())
    n_rows = int(many.sum())
    if n_rows > CLUSTERS:
        shared = spark.sparkContext.broadcast((v, row, col))

        def company(batches):
            v, row, col = shared.value
            out = np.zeros(n_rows * 2 * COMPANY, np.int64)
            for _, _, _, t in _text_chunks(batches):
                at = v.find(t.h)
                prev = t.before(at, -1)
                pairs = [(row[at], col[prev], 0), (row[prev], col[at], COMPANY)]
                for r, c, shift in pairs:
                    ok = (r >= 0) & (c >= 0)
                    out += np.bincount(r[ok].astype(np.int64) * 2 * COMPANY + c[ok] + shift, minlength=len(out))
            return out

        profile = tree_sum(texts, company, n_rows * 2 * COMPANY, "i8").reshape(n_rows, -1).astype(np.float64)
        shared.destroy()
        v.cls[many] = 1 + cluster(profile, v.c[many], CLUSTERS)

    # counts of each class
    size, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    np.add.at(size, v.cls, v.c)
    np.add.at(kinds, v.cls, 1)
    for s, t, n in counts.filter(step < least).groupBy(F.col("tok").bitwiseAND(F.lit(7)).alias("s")).agg(F.sum("c"), F.count("*")).collect():
        size[1 + CLUSTERS + s] += t
        kinds[1 + CLUSTERS + s] += n
    kinds[1 + CLUSTERS :] += 1  # the unknown token
    logs = np.log10(np.maximum(size + kinds, 1))

    share = (size + 1) / (size + 1).sum()
    bias = np.log(share).astype(np.float32)
    shared = spark.sparkContext.broadcast(v)
    n = tree_sum(texts, _start(shared), FEATURES * BUCKETS * CLASSES, "i8").reshape(-1, CLASSES)
    shared.destroy()
    weights = (SHARE * (np.log((n + PRIOR * share) / (n.sum(axis=1, keepdims=True) + PRIOR)) - np.log(share))).astype(np.float32)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((v, weights, bias))
        got = tree_sum(texts, _train(shared), weights.size + CLASSES + 1, "f4")
        if got[-1]:
            weights = (got[: weights.size] / got[-1]).reshape(weights.shape)
            bias = got[weights.size : -1] / got[-1]
        shared.destroy()
    return counts, (int(total), int(distinct)), v, weights, bias, logs


# ------------------------------------------------------------------ features of the token factor
_zstd = pa.Codec("zstd", compression_level=1)


def _pack(x: np.ndarray) -> bytes:
    """An array's bytes, those of one rank together, compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + _zstd.compress(raw, asbytes=True)


def _unpack(raw: bytes, dtype) -> np.ndarray:
    data = np.frombuffer(_zstd.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True), np.uint8)
    return np.ascontiguousarray(data.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


class Often:
    """Histories that stand too often for one shard: previous tokens, and pairs of these with the token before.

    place: where a token of the vocabulary, any other (last but one) or the start (last)
    stands among the frequent ones, else -1; pairs: place of the token before times
    their number, plus place of the previous token, sorted.
    """

    def __init__(self, v: Vocabulary, documents: int):
        many = (v.c > SHARD) & (v.h != END)
        n = int(many.sum())
        self.place = np.full(len(v.h) + 2, -1, np.int32)
        self.place[:-2][many] = np.arange(n)
        if documents > SHARD:
            self.place[-1] = n
        self.heads = np.concatenate([v.h[many], np.full(1, START)])
        self.split = np.maximum(1, -(-np.concatenate([v.c[many], [documents]]) // SHARD)).astype(np.uint64)
        self.pairs, self.pair_split = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return int(self.place.max()) + 1

    def set_pairs(self, found: dict[int, int]) -> None:
        self.pairs = np.array(sorted(found), np.int64)
        self.pair_split = np.array([-(-found[k] // SHARD) for k in sorted(found)], np.uint64)

    def find(self, t: Tokens, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the previous token, place of the pair) for each token; -1 where not frequent."""
        prev = self.place[t.before(np.where(at >= 0, at, len(self.place) - 2), len(self.place) - 1)]
        pair = np.full(len(prev), -1, np.int64)
        if len(self.pairs):
            before = t.before(prev, self.place[-1])
            k = np.flatnonzero((prev >= 0) & (before >= 0))
            key = before[k].astype(np.int64) * len(self.heads) + prev[k]
            found = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            pair[k] = np.where(self.pairs[found] == key, found, -1)
        return prev, pair

    def of_pair(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of its token before and of its previous token."""
        return self.pairs[pair] // len(self.heads), self.pairs[pair] % len(self.heads)


def _codes(at: np.ndarray, cls: np.ndarray) -> np.ndarray:
    return np.where(at >= 0, at, HOT + cls.astype(np.int64)).astype(np.uint32)


def _before(h: np.ndarray) -> np.ndarray:
    return (mix(h + U64(5)) >> U64(48)).astype(np.uint32)


TABLES = "place int, code binary, n binary, often array<long>"


def _table_rows(rows) -> pa.RecordBatch:
    types = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in TABLES.split(", ")])


def _tally(shared):
    """Counts of the tokens after each frequent history of a partition: of previous tokens, or of pairs where these are given."""

    def run(batches):
        v, often = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows():
            _merge(held)
            h, c = held.pop()
            first = _groups(h >> 20)[0]
            edge = [*first.tolist(), len(h)]
            for i in range(0, len(first), 64):
                ranges = list(zip(edge[i : i + 64], edge[i + 1 : i + 65], strict=False))
                yield _table_rows([(int(h[lo] >> 20), _pack(np.diff(h[lo:hi] & 0xFFFFF, prepend=0).astype(np.uint32)), _pack(c[lo:hi].astype(np.int64)), None) for lo, hi in ranges])

        for _, _, _, t in _text_chunks(batches):
            at, cls = classes_of(v, t)
            prev, pair = often.find(t, at)
            place = pair if len(often.pairs) else prev
            k = np.flatnonzero(place >= 0)
            if not len(k):
                continue
            held.append(np.unique(place[k].astype(np.int64) << 20 | _codes(at[k], cls[k]), return_counts=True))
            if len(held) > 16:
                _merge(held)
                if len(held[0][0]) > 1_000_000:
                    yield from rows()
        if held:
            yield from rows()

    return run


def _add_up(limit: int):
    """Rows come sorted by place: one table for each, and its tokens that stand more than limit times, below their counts."""

    def run(batches):
        now, total = None, np.zeros(HOT + CLASSES, np.int64)

        def close():
            if now is None:
                return
            used = np.flatnonzero(total)
            yield _table_rows([(now, _pack(np.diff(used, prepend=0).astype(np.uint32)), _pack(total[used]), [int(total[x]) << 20 | x for x in used[total[used] > limit].tolist()])])
            total[:] = 0

        for b in batches:
            place = b.column(0).to_pylist()
            for k in range(b.num_rows):
                if place[k] != now:
                    yield from close()
                    now = place[k]
                total[np.cumsum(_unpack(b.column(1)[k].as_py(), np.uint32))] += _unpack(b.column(2)[k].as_py(), np.int64)
        yield from close()

    return run


def _deal(shared, shards: int, level: int):
    """Each table, for every shard that holds a part of its history. level: 1 for previous tokens, 2 for pairs."""

    def run(batches):
        _, _, often = shared.value
        before, prev = often.of_pair(np.arange(len(often.pairs)))
        for b in batches:
            for k in range(b.num_rows):
                place = b.column(0)[k].as_py()
                pairs = np.flatnonzero(prev == place) if level == 1 else np.array([place])
                salts = [(mix(often.heads[before[i : i + 1]]) + np.arange(often.pair_split[i], dtype=np.uint64), _before(often.heads[before[i : i + 1]])) for i in pairs.tolist()]
                if level == 1:
                    salts.append((np.arange(often.split[place], dtype=np.uint64) + U64(1), np.zeros(1, np.uint32)))
                head = often.heads[[place] if level == 1 else prev[place : place + 1]]
                code, n = b.column(1)[k].as_py(), b.column(2)[k].as_py()
                for salt, second in salts:
                    hist = mix(mix(head) + salt)
                    for i in range(0, len(hist), 16):
                        yield _event_rows([(int(x % U64(shards)), 0, level, _pack((hist[j : j + 1] >> U64(32)).astype(np.uint32)), code, _pack(second), n, None) for j, x in enumerate(hist[i : i + 16], i)])

    return run


def frequent(texts: DataFrame, v: Vocabulary, documents: int) -> tuple[Often, list[DataFrame]]:
    """The histories beyond one shard, and tables of the tokens after each: of previous tokens, then of pairs."""
    spark, often, tables = texts.sparkSession, Often(v, documents), []
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while len(often) and len(tables) < 2:
        shared = spark.sparkContext.broadcast((v, often))
        rows = arrow_map(texts, _tally(shared), TABLES).repartition(n, "place").sortWithinPartitions("place")
        tables.append(cut(arrow_map(rows, _add_up(SHARD // 2), TABLES), "lm-often", "none"))
        shared.destroy()
        if len(tables) == 2:
            break
        found, width, start = {}, len(often.heads), int(often.place[-1])
        for place, x in tables[0].select("place", F.explode("often")).toLocalIterator():
            if (code := x & 0xFFFFF) < HOT and often.place[code] >= 0:
                found[place * width + int(often.place[code])] = x >> 20
        if start >= 0:
            found[start * width + start] = documents
        if not found:
            break
        often.set_pairs(found)
    return often, tables


EVENTS = "shard int, chunk long, part int, hist binary, code binary, before binary, doc binary, keys binary"


def _event_rows(rows) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in EVENTS.split(", ")])


def _events(shared, shards: int):
    """Tokens with their histories, packed by chunk and shard, and each chunk's documents.

    hist: 32 bits of the previous token; code: the token's place among the hot ones, or
    HOT + its class; before: 16 bits of the token before; doc: place in the chunk, and
    whether it is of the training rows. A table of a frequent history (part: its level)
    has its counts for doc.
    """

    def run(batches):
        v, _, often = shared.value
        part, serial, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def flush():
            nonlocal serial, size
            if not held:
                return
            hist, code, before, doc, keys = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            size, chunk = 0, part + serial
            serial += 1
            shard = (hist % U64(shards)).astype(np.int64)
            hist = (hist >> U64(32)).astype(np.uint64)
            order = np.argsort(shard << 32 | hist.view(np.int64))
            edge = np.searchsorted(shard[order], np.arange(shards + 1))
            yield _event_rows([(int(chunk % shards), chunk, -1, None, None, None, None, _pack(keys))])
            rows = []
            for k in np.flatnonzero(np.diff(edge)).tolist():
                at = order[edge[k] : edge[k + 1]]
                rows.append((k, chunk, 0, _pack(np.diff(hist[at], prepend=0).astype(np.uint32)), _pack(code[at]), _pack(before[at]), _pack(doc[at]), None))
                if len(rows) >= 64:
                    yield _event_rows(rows)
                    rows = []
            if rows:
                yield _event_rows(rows)

        base = 0
        for b, i, j, t in _text_chunks(batches, 2):
            at, cls = classes_of(v, t)
            prev = t.before(t.h, START)
            keys = b.column(0).slice(i, j - i).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(j - i), t.counts)
            code, before, salt = _codes(at, cls), _before(t.before(prev, START)), np.zeros(len(prev), np.uint64)
            if len(often):
                place, pair = often.find(t, at)
                k = np.flatnonzero(place >= 0)
                salt[k] = before[k].astype(np.uint64) % often.split[place[k]] + U64(1)
                k = np.flatnonzero(pair >= 0)
                by = pair[k]
                salt[k] = mix(often.heads[often.of_pair(by)[0]]) + mix(keys.view(np.uint64) + U64(77))[row[k]] % often.pair_split[by]
            hist = mix(mix(prev) + salt)
            if not held:
                base = 0
            train = np.array(b.column(1).slice(i, j - i).to_numpy(zero_copy_only=False), bool)
            held.append((hist, code, before, ((base + row) * 2 + train[row]).astype(np.uint32), keys))
            base += j - i
            size += len(code)
            if size >= CHUNK:
                yield from flush()
        yield from flush()

    return run


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, group of each) of runs of equal values in a sorted array."""
    new = np.concatenate([[True], x[1:] != x[:-1]])
    return np.flatnonzero(new), np.cumsum(new) - 1


def ratios(hist: np.ndarray, cls: np.ndarray, code: np.ndarray, before: np.ndarray, train: np.ndarray, share: np.ndarray, train3: np.ndarray | None = None) -> np.ndarray:
    """P(token | class, history) over its share of the class, for tokens of one shard.

    A class's tokens seen after a history get their discounted shares of its training
    tokens; the others keep their proportions in what is left. train: how often each
    stands in training; train3: the same for triples, where it differs.
    """

    def level(group: np.ndarray, n_groups: int, token: np.ndarray, p: np.ndarray, discount: float) -> np.ndarray:
        """group: history and class, sorted; token: sorted inside; p: the probability without these features."""
        pair_first, pair = _groups(group.astype(np.int64) << 20 | token)
        n = np.add.reduceat(train_.astype(np.float64), pair_first)
        g = group[pair_first]
        total = np.bincount(g, n, n_groups)
        own = (token[pair_first] < HOT) & (n > 0)
        base = p[pair_first]
        used = np.bincount(g, base * own, n_groups)
        every = used > 1 - 1e-9  # all tokens of the class were seen: nothing is left for others
        q = np.where(own, (n - np.where(every[g], 0.0, discount)) / np.maximum(total[g], 1), 0.0)
        got = np.bincount(g, q, n_groups)
        rest = np.where(every, 1.0, (1 - got) / np.maximum(1 - used, 1e-12))
        q = np.where(every[g] & own, q / np.maximum(got[g], 1e-12), q)
        return np.where(own, q / np.maximum(base, 1e-300), rest[g])[pair]

    k1 = (hist.astype(np.uint64) << U64(26)) | (cls.astype(np.uint64) << U64(20)) | code.astype(np.uint64)
    order = np.argsort(k1)
    k1, train_ = k1[order], train[order]
    first, group = _groups(k1 >> U64(20))
    p = share[order]
    r = level(group, len(first), code[order].astype(np.int64), p, DISCOUNT)
    p = p * r
    k2 = (group.astype(np.uint64) << U64(40)) | (before[order].astype(np.uint64) << U64(20)) | code[order].astype(np.uint64)
    again = np.argsort(k2)
    k2, train_ = k2[again], (train if train3 is None else train3)[order][again]
    first, group = _groups(k2 >> U64(20))
    more = level(group, len(first), code[order][again].astype(np.int64), p[again], DISCOUNT3)
    out = np.empty(len(hist))
    out[order] = r
    out[order[again]] *= more
    return out


SUMS = "chunk long, keys binary, doc binary, add binary"


def _shards(shared):
    """Rows come sorted by shard: the sum of the log ratios of each document's tokens in a shard."""

    def run(batches):
        v, logs, _ = shared.value
        share_hot = (v.c + 1) / 10 ** logs[v.cls] if len(v.h) else np.zeros(1)
        now, held, tables = None, [], []

        def close():
            if not held:
                tables.clear()
                return
            sizes = [len(h) for _, h, _, _, _ in held]
            hist, code, before, doc = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3, 4))
            train = train3 = (doc & 1).astype(bool)
            if tables:
                # tokens of a history with a table count by the table
                train, train3 = (np.where(np.isin(hist, [h for level, h, *_ in tables if level == k]), 0, train) for k in (1, 2))
                more = [len(c) for _, _, c, _, _ in tables]
                hist = np.concatenate([hist, np.repeat(np.array([h for _, h, *_ in tables], np.uint32), more)])
                before = np.concatenate([before, np.repeat(np.array([x[3] for x in tables], np.uint32), more)])
                code = np.concatenate([code, *[x[2] for x in tables]])
                train, train3 = (np.concatenate([x, *[n if level == k else np.zeros_like(n) for level, *_, n in tables]]) for k, x in ((1, train), (2, train3)))
                tables.clear()
            hot = code < HOT
            place = np.where(hot, code, 0)
            cls = np.where(hot, v.cls[place] if len(v.h) else 0, code.astype(np.int64) - HOT)
            log = np.log10(ratios(hist, cls, code, before, train, np.where(hot, share_hot[place], 0.0), train3)[: len(doc)])
            at, rows = 0, []
            for (chunk, *_), n in zip(held, sizes, strict=True):
                d, x = doc[at : at + n] >> 1, log[at : at + n]
                at += n
                sums, seen = np.bincount(d, x), np.bincount(d)
                used = np.flatnonzero(seen)
                rows.append((chunk, None, _pack(np.diff(used, prepend=0).astype(np.uint32)), _pack(sums[used].astype(np.float32))))
            held.clear()
            yield batch(rows)

        def batch(rows):
            types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in SUMS.split(", ")])

        for b in batches:
            shard, chunk, part = (b.column(i).to_pylist() for i in range(3))
            for k in range(b.num_rows):
                if part[k] < 0:
                    yield batch([(chunk[k], b.column(7)[k].as_py(), None, None)])
                    continue
                if shard[k] != now:
                    yield from close()
                    now = shard[k]
                if part[k] > 0:
                    hist, before = (int(_unpack(b.column(i)[k].as_py(), np.uint32)[0]) for i in (3, 5))
                    tables.append((part[k], hist, np.cumsum(_unpack(b.column(4)[k].as_py(), np.uint32), dtype=np.uint32), before, _unpack(b.column(6)[k].as_py(), np.int64)))
                    continue
                hist = np.cumsum(_unpack(b.column(3)[k].as_py(), np.uint32), dtype=np.uint64).astype(np.uint32)
                held.append((chunk[k], hist, *(_unpack(b.column(i)[k].as_py(), np.uint32) for i in (4, 5, 6))))
        yield from close()

    return run


def _chunks(batches):
    """Rows come sorted by chunk, its documents first: the sum of each document."""
    keys = total = None

    def close():
        if keys is not None:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total)], ["key", "add"])

    for b in batches:
        for k in range(b.num_rows):
            if (raw := b.column(1)[k].as_py()) is not None:
                yield from close()
                keys = _unpack(raw, np.int64)
                total = np.zeros(len(keys))
                continue
            total[np.cumsum(_unpack(b.column(2)[k].as_py(), np.uint32))] += _unpack(b.column(3)[k].as_py(), np.float32)
    yield from close()


def token_factor(src: DataFrame, v: Vocabulary, logs: np.ndarray, tokens: int, documents: int) -> DataFrame:
    """(key, add): the log10 ratio that the token factor's features give each document. src: key, train, text."""
    spark = src.sparkSession
    shards = max(1, -(-tokens // SHARD))
    n = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    often, tables = frequent(src.filter("train").select("text"), v, documents)
    shared = spark.sparkContext.broadcast((v, logs, often))
    events = arrow_map(src, _events(shared, shards), EVENTS)
    for level, x in enumerate(tables, 1):
        events = events.unionByName(arrow_map(x, _deal(shared, shards, level), EVENTS))
    events = events.repartition(n, "shard").sortWithinPartitions("shard", "part")
    sums = cut(arrow_map(events, _shards(shared), SUMS), "lm-shards", "none")
    shared.destroy()
    sums = sums.repartition(n, "chunk").sortWithinPartitions("chunk", F.col("keys").isNull())
    return arrow_map(sums, _chunks, "key long, add double").groupBy("key").agg(F.avg("add").alias("ratio"))


def score(docs: DataFrame, *, rounds: int = ROUNDS) -> DataFrame:
    """The contract's row per document."""
    counts, (total, distinct), v, weights, bias, logs = fit(docs, rounds=rounds)
    shared = docs.sparkSession.sparkContext.broadcast((v, weights, bias, logs))
    base_log = float(np.log10(total + distinct + 1))

    def run(batches):
        v, w, bias, logs = shared.value
        part, serial = TaskContext.get().partitionId() << 33, 0
        hot_log = np.log10(v.c + 1)
        for b, i, j, t in _text_chunks(batches, 2):
            at, cls = classes_of(v, t)
            f, by = features(t), np.empty(len(cls))
            for k in range(0, len(cls), BATCH):
                z, _, total = softmax(w, bias, f[:, k : k + BATCH])
                by[k : k + BATCH] = z[np.arange(len(z)), cls[k : k + BATCH]] - np.log(total[:, 0])
            known = at >= 0
            own = np.where(known, hot_log[at] if len(v.h) else 0.0, 0.0)
            sums = lambda x: np.add.reduceat(x, t.first)
            n = t.counts.astype(np.int64)
            base = sums(own) - n * base_log
            model = sums(by / np.log(10) + own - logs[cls])
            rare = ~known
            lens = sums(rare.astype(np.int64))
            rid = part + serial + np.arange(j - i)
            serial += j - i
            yield pa.RecordBatch.from_arrays(
                [b.column(3).slice(i, j - i), pa.array(rid), b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n), pa.array(n - lens), pa.array(base), pa.array(model), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), i64(t.h[rare]))],
                ["key", "rid", "doc_id", "held_out", "n", "known", "base", "model", "rare"],
            )

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    key = F.xxhash64("doc_id", "text").alias("key")
    src = docs.select("doc_id", (fold("doc_id", PARTS) == HELD).alias("held_out"), "text", key)
    part = cut(arrow_map(src, run, f"key long, rid long, doc_id {kind}, held_out boolean, n long, known long, base double, model double, rare array<long>"), "lm-parts", "none")
    rare = part.select("rid", F.explode("rare").alias("tok")).join(counts.select("tok", "c"), "tok")
    rare = rare.groupBy("rid").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("add"))
    shared.destroy()
    sizes = part.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ratio = cut(token_factor(docs.select(key, (fold("doc_id", PARTS) != HELD).alias("train"), "text"), v, logs, *sizes), "lm-ratios")
    out = part.drop("rare").join(rare, "rid", "left").join(ratio, "key", "left")
    add = F.coalesce("add", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + add).alias("base_score"),
        (F.col("model") + add + F.coalesce("ratio", F.lit(0.0))).alias("score"),
    )
