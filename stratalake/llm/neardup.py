"""Near-duplicate documents with b-bit MinHash.

1. Each text becomes its set of distinct word 5-grams, as 64-bit hashes (a text of
   fewer words is one shingle, one without words the empty set). Equal sets form one
   class, found by a 128-bit digest, so exact copies never meet each other again.
2. A class representative gets 192 minima. Whole minima, six to a band, make 32 band
   keys; of each minimum only four low bits stay, packed as bit planes of 64 lanes.
   A pair at op3's threshold 0.85 misses all bands with probability 3e-7, one at the
   pipeline's 0.8 with 6e-5.
3. Buckets are never expanded into pairs. Each bucket links its members to one
   leader, the member that shares most buckets overall. The packed signatures give a
   collision-corrected estimate by bit counts; candidates six standard deviations
   below the threshold go, the rest are confirmed on full shingle sets.
4. Components of the confirmed links come from alternating large-star and small-star
   rounds. Members of one bucket that are still in different components are then
   compared across components: the members outside the bucket's main component, as
   queries, with blocks of at most about WIDE members. First only sketches meet, of FINE
   minima with one bit each; a member outlives this in the parts (of about BLOCK) where
   its estimate with some other is within six standard deviations of the threshold.
   Texts of these alone follow, to those parts, for the exact check. A pair is compared
   in the first band it shares, and a query reports one link for each component it
   meets, so what a group gives out follows its size while no link between components
   is lost. The components are then final.

Defined results: a null id is never linked (component_id null, kept true); a repeated
doc_id is one document with the texts of all its rows, and each of its rows is
returned; empty and null texts are linked with nothing; an empty table gives no row; a
very long text is one row throughout, its set built block by block; extra columns are
not read.

Scale: text is read twice and shuffled once (only candidate rows travel further), band
rows are 16 bytes, copies collapse in a partial aggregation, verification groups hold
at most some hundred texts, and every loop cuts lineage with a written table. Leaders
meet their stars on a salted key. A hot bucket whose members are no copies of each other
(similar texts under the threshold) costs a sketch of half a kilobyte for each member,
bucket and WIDE members of it; its texts are not sent at all unless their similarity
comes close to the threshold. Up to WIDE members a bucket's cost in rows is linear,
beyond that it grows with size / WIDE. Nothing is collected but scalar counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.llm.common import U64, arrow_map, chunks, cut, i64, mix, release, utf8, word_table

SHINGLE = 5
THRESHOLD = 85  # percent
BANDS, ROWS, BITS, LANES = 32, 6, 4, 64
PERMS = BANDS * ROWS
WORDS64 = PERMS // LANES
SIGMAS = 6.0
GROUP, SPLIT = 64, 256
BLOCK, WIDE = 512, 2048
FINE = 3072
"""Lanes of the one-bit sketch: a standard deviation of 0.01 at the threshold."""

_rng = np.random.default_rng(7041)
_A = _rng.integers(1, 1 << 62, PERMS, dtype=np.uint64) * U64(2) + U64(1)
_B = _rng.integers(1, 1 << 62, PERMS, dtype=np.uint64)
_FA = _rng.integers(1, 1 << 31, FINE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FB = _rng.integers(0, 1 << 32, FINE, dtype=np.uint32)
_STEP = [mix(np.array([k + 1], np.uint64))[0] | U64(1) for k in range(SHINGLE)]


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    _, _, h, counts = word_table(data, off)
    at = np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):
        n = max(0, len(h) - k + 1)
        s = np.zeros(n, np.uint64)
        for j in range(k):
            s += h[j : j + n] * _STEP[j]
        s = mix(s)
        out = []
        for i, c in enumerate(counts):
            a = at[i]
            if c >= k:
                out.append(np.unique(s[a : a + c - k + 1]))
            elif c:
                short = h[a : a + c] * np.array(_STEP[:c])
                out.append(mix(np.array([short.sum(dtype=np.uint64) + U64(c)])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    with np.errstate(over="ignore"):
        return int(mix(s + U64(11)).sum(dtype=np.uint64)), int(mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(PERMS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 1024):
            np.minimum(out, (s[i : i + 1024, None] * _A + _B).min(axis=0), out=out)
    return out


def signature(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, bit planes) of the minima of rows: planes[r, w * BITS + p] holds bit p of 64 lanes."""
    with np.errstate(over="ignore"):
        keys = np.zeros((len(m), BANDS), np.uint64)
        for r in range(ROWS):
            keys = mix(keys + m[:, r::ROWS])
        keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
    low = (m >> U64(32)).astype(np.uint64)
    lanes = low.reshape(len(m), WORDS64, LANES)
    planes = np.stack([(((lanes >> U64(p)) & U64(1)) << np.arange(LANES, dtype=np.uint64)).sum(axis=2, dtype=np.uint64) for p in range(BITS)], axis=2)
    return keys, planes.reshape(len(m), -1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = utf8(b.column(1))
        for i, j in chunks(off):
            sets = shingle_sets(data, off[i : j + 1])
            n = np.array([len(s) for s in sets], np.int64)
            d = np.array([digest(s) for s in sets], np.uint64).reshape(-1, 2)
            keys, planes = signature(np.stack([minima(s) for s in sets]))
            lists = lambda x, k: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, k), pa.int32()), i64(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), i64(d[:, 0].copy()), i64(d[:, 1].copy()), lists(keys, BANDS), lists(planes, WORDS64 * BITS)], ["doc_id", "n", "h1", "h2", "keys", "planes"])


def estimate(a: Column, b: Column) -> Column:
    """Jaccard similarity from packed planes: lanes that differ, by bit counts, corrected for chance agreement."""
    miss = None
    for w in range(WORDS64):
        x = None
        for p in range(BITS):
            y = a[w * BITS + p].bitwiseXOR(b[w * BITS + p])
            x = y if x is None else x.bitwiseOR(y)
        c = F.bit_count(x)
        miss = c if miss is None else miss + c
    chance = 2.0**-BITS
    return (1 - miss / F.lit(float(PERMS)) - chance) / (1 - chance)


def floor_estimate(threshold: int) -> float:
    """The least estimate that a true pair shows, but for SIGMAS standard deviations."""
    j, chance = threshold / 100, 2.0**-BITS
    p = j + (1 - j) * chance
    return (p - SIGMAS * (p * (1 - p) / PERMS) ** 0.5 - chance) / (1 - chance)


def candidate(na: Column, nb: Column, pa_: Column, pb: Column, threshold: int) -> Column:
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * threshold) & (estimate(pa_, pb) >= floor_estimate(threshold))


def _verify(threshold: int):
    """Rows come sorted by group with the leader first; a leader is compared with its group, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leaders = None, []
        for b in batches:
            a_id, part, doc, lead = (b.column(i).to_pylist() for i in range(4))
            data, off = utf8(b.column(4))
            out = []
            for i, j in chunks(off):
                for k, s in enumerate(shingle_sets(data, off[i : j + 1]), i):
                    if (a_id[k], part[k]) != group:
                        group, leaders = (a_id[k], part[k]), []
                    if lead[k]:
                        leaders.append(s)
                        continue
                    for t in leaders:
                        both = len(np.intersect1d(s, t, assume_unique=True))
                        if both and 100 * both >= threshold * (len(s) + len(t) - both):
                            out.append((a_id[k], doc[k]))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return run


def verify(pairs: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough. Each text is compared in groups of a and about GROUP partners; c is the size of the bucket that joins a and b."""
    placed = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / GROUP)).cast("int").alias("part"))
    placed = cut(placed, "nd-placed")
    members = placed.select("a", "part", F.col("b").alias("doc"), F.lit(False).alias("lead"))
    leads = placed.select("a", "part").distinct().select("a", "part", F.col("a").alias("doc"), F.lit(True).alias("lead"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    # one way at every size: the text is shuffled once, by its id
    rows = members.unionByName(leads).join(text.hint("merge"), "doc")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.select("a", "part", "doc", "lead", "text").repartition(n, "a", "part").sortWithinPartitions("a", "part", F.desc("lead"))
    return arrow_map(rows, _verify(threshold), "a long, b long")


def estimates(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Estimated similarity of one packed signature with many, as `estimate` has it."""
    d = (planes ^ x).reshape(len(planes), WORDS64, BITS)
    miss = np.bitwise_count(np.bitwise_or.reduce(d, axis=2)).sum(axis=1)
    return (1 - miss / PERMS - 2.0**-BITS) / (1 - 2.0**-BITS)


def fine(s: np.ndarray) -> np.ndarray:
    """One bit of each of FINE minima of a set, packed."""
    x = (s >> U64(32)).astype(np.uint32)
    out = np.full(FINE, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 16):
        np.minimum(out, (x[i : i + 16, None] * _FA + _FB).min(axis=0), out=out)
    bits = mix(out.astype(np.uint64) + np.arange(FINE, dtype=np.uint64) * U64(1 << 32)) >> U64(63)
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def fine_estimates(x: np.ndarray, many: np.ndarray) -> np.ndarray:
    return 1 - 2 * np.bitwise_count(many ^ x).sum(axis=1) / FINE


def fine_floor(threshold: int) -> float:
    """As floor_estimate, for the one-bit sketch."""
    p = (1 + threshold / 100) / 2
    return 2 * (p - SIGMAS * (p * (1 - p) / FINE) ** 0.5) - 1


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = utf8(b.column(1))
        for i, j in chunks(off):
            sets = shingle_sets(data, off[i : j + 1])
            rows = pa.array([fine(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), rows], ["node", "n", "fine"])


def _near(threshold: int):
    """Rows come sorted by bucket, block and role, without texts: (key, block, part, role, node, comp, is_main) of all that some other may be linked with."""
    least = fine_floor(threshold)
    names = ["key", "block", "part", "role", "node", "comp", "is_main"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, block, out = None, [], None, []

        def close():
            if block is not None:
                nodes, comps, main, _, _, _, part, used = block
                out.extend((*group, int(part[k]), 0, int(nodes[k]), int(comps[k]), bool(main[k])) for k in np.flatnonzero(used))

        def rows():
            cols = [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 7, kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            key, at, role, node, comp, main, n = (b.column(i).to_pylist() for i in range(7))
            keys = b.column(7).flatten().to_numpy().view(np.uint64).reshape(-1, BANDS).astype(np.uint32)
            prints = b.column(8).flatten().to_numpy().view(np.uint64).reshape(-1, FINE // 64)
            for k in range(b.num_rows):
                if (key[k], at[k]) != group:
                    close()
                    group, held, block = (key[k], at[k]), [], None
                if role[k] == 0:
                    held.append((node[k], comp[k], main[k], n[k], keys[k], prints[k]))
                    continue
                if not held:
                    continue
                if block is None:
                    x = list(zip(*held, strict=True))
                    nodes = np.array(x[0], np.int64)
                    parts = (mix(nodes.view(np.uint64)) % U64(-(-len(nodes) // BLOCK))).astype(np.int64)
                    block = nodes, np.array(x[1], np.int64), np.array(x[2], bool), np.array(x[3], np.int64), np.stack(x[4]), np.stack(x[5]), parts, np.zeros(len(nodes), bool)
                nodes, comps, mains, sizes, all_keys, all_prints, parts, used = block
                few, many = np.minimum(sizes, n[k]), np.maximum(sizes, n[k])
                to = np.flatnonzero((comps != comp[k]) & (mains | (nodes < node[k])) & (100 * few >= threshold * many))
                if len(to):
                    band = int(np.argmax(keys[k] == np.uint32(key[k] & 0xFFFFFFFF)))
                    to = to[np.argmax(all_keys[to] == keys[k], axis=1) == band]
                if len(to):
                    to = to[fine_estimates(prints[k], all_prints[to]) >= least]
                    used[to] = True
                    out.extend((*group, int(p), 1, node[k], comp[k], False) for p in np.unique(parts[to]))
                if len(out) > 20_000:
                    yield rows()
        close()
        yield rows()

    return run


def _cross(threshold: int):
    """Rows come sorted by bucket, block and role: a block's members, held, then the queries against them."""
    least = floor_estimate(threshold)

    def lists(col: pa.Array, k: int) -> np.ndarray:
        return col.flatten().to_numpy().view(np.uint64).reshape(-1, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, block = None, [], None
        for b in batches:
            key, part, role, node, comp, main = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            keys, planes = lists(b.column(6), BANDS), lists(b.column(7), WORDS64 * BITS)
            data, off = utf8(b.column(8))
            out = []
            for i, j in chunks(off):
                for k, s in enumerate(shingle_sets(data, off[i : j + 1]), i):
                    if (key[k], part[k]) != group:
                        group, held, block = (key[k], part[k]), [], None
                    if role[k] == 0:
                        held.append((node[k], comp[k], main[k], keys[k], planes[k], s))
                        continue
                    if block is None:
                        if not held:
                            continue
                        n, c, m, kk, pp, ss = zip(*held, strict=True)
                        block = np.array(n), np.array(c), np.array(m, bool), np.stack(kk), np.stack(pp), ss, np.array(list(map(len, ss)))
                    out += _links(node[k], comp[k], keys[k], planes[k], s, np.uint64(np.int64(key[k]).view(np.uint64)), block, least, threshold)
            yield pa.RecordBatch.from_arrays([pa.array([int(x) for x, _ in out], pa.int64()), pa.array([int(y) for _, y in out], pa.int64())], ["a", "b"])

    return run


def _links(node, comp, keys, planes, s, key, block, least, threshold) -> list[tuple[int, int]]:
    """One confirmed link of a query to each component of a block that it has any with."""
    nodes, comps, main, all_keys, all_planes, sets, sizes = block
    few, many = np.minimum(sizes, len(s)), np.maximum(sizes, len(s))
    at = np.flatnonzero((comps != comp) & (main | (nodes < node)) & (100 * few >= threshold * many))
    if len(at):
        band = int(np.argmax(keys == key))
        at = at[np.argmax(all_keys[at] == keys, axis=1) == band]
    if len(at):
        near = estimates(planes, all_planes[at])
        at = at[np.argsort(-near, kind="stable")][: int((near >= least).sum())]
    out, done = [], set()
    for i in range(0, len(at), 64):
        some = [k for k in at[i : i + 64] if comps[k] not in done]
        if not some:
            continue
        joined = np.concatenate([sets[k] for k in some])
        place = np.minimum(np.searchsorted(s, joined), len(s) - 1)
        both = np.add.reduceat((s[place] == joined).astype(np.int64), np.concatenate([[0], np.cumsum([len(sets[k]) for k in some])[:-1]]))
        for k, x in zip(some, both, strict=True):
            if comps[k] not in done and 100 * x >= threshold * (len(s) + sizes[k] - x):
                done.add(comps[k])
                out.append((nodes[k], node))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b).

    Alternating large-star and small-star rounds until an edge set repeats itself.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())

    now = mark(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        done = cut(small, "cc")
        then = mark(done)
        release(edges)
        edges = done
        if then == now:
            break
        now = then
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def link(docs: DataFrame, *, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(sketches, components): a row per document with its set's digest, and (node, component) for every linked node."""
    sketch = cut(arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), _sketch, "doc_id long, n long, h1 long, h2 long, keys array<long>, planes array<long>"), "nd-sketch", "none")
    full = sketch.filter("n > 0 and doc_id is not null")
    classes = cut(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")), "nd-classes")
    reps = full.join(classes.select("h1", "h2", F.col("node").alias("doc_id")), ["doc_id", "h1", "h2"]).dropDuplicates(["doc_id", "h1", "h2"])
    sig = cut(reps.select(F.col("doc_id").alias("node"), "n", "planes", "keys"), "nd-sig", "none")
    rows = sig.select("node", F.explode("keys").alias("key"))
    # written, so that the join reads both sides straight from a shuffle and can split a hot key
    shared = cut(rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "nd-shared", "none")
    member = cut(rows.join(shared, "key"), "nd-member", "none")
    score = member.groupBy("node").agg(F.sum("c").alias("score"))
    ranked = member.join(score, "node")
    leader = ranked.groupBy("key").agg(F.max(F.struct("score", (-F.col("node")).alias("neg"))).alias("top")).select("key", (-F.col("top.neg")).alias("a"))
    # a large bucket meets its leader in parts
    member = member.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / SPLIT)))
    leader = member.select("key", "part").distinct().join(leader, "key")
    star = member.join(leader, ["key", "part"]).filter("a <> node").groupBy("a", F.col("node").alias("b")).agg(F.max("c").alias("c"))
    star = cut(star.withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / SPLIT))), "nd-stars", "none")
    planes = sig.select("node", "n", "planes")
    left = planes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("planes").alias("ap"))
    right = planes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("planes").alias("bp"))
    near = candidate(F.col("na"), F.col("nb"), F.col("ap"), F.col("bp"), threshold)
    leaders = star.select("a", "salt").distinct().join(left, "a")
    tried = cut(star.join(right, "b").join(leaders, ["a", "salt"]).filter(near).select("a", "b", "c"), "nd-star")
    links = cut(verify(tried, docs, threshold), "nd-links")
    # the rows of a repeated id may stand in several classes
    several = full.select("doc_id", "h1", "h2").distinct().groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1")
    same = full.join(several, "doc_id").join(classes, ["h1", "h2"]).select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    links = links.unionByName(same)
    comps = cut(components(links), "nd-comps")

    # members of one bucket in different components
    placed = member.drop("part").filter("c > 2").join(comps, "node", "left").select("key", "node", "c", F.coalesce("component", "node").alias("comp"))
    main = placed.groupBy("key", "comp").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("comps"))
    main = cut(main.filter("comps > 1").select("key", F.col("top.comp").alias("main"), F.col("top.k").alias("k")), "nd-main", "none")
    turns = F.ceil((F.col("c") - F.col("k")) / WIDE).cast("int")
    placed = cut(placed.join(main, "key").withColumn("blocks", F.ceil(F.col("c") / WIDE).cast("int")).withColumn("turns", turns).drop("k"), "nd-mixed", "none")
    if placed.limit(1).count():
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        text = docs.select(F.col("doc_id").cast("long").alias("node"), "text").hint("merge")
        whole = cut(placed.select("node").distinct().join(text, "node"), "nd-whole")
        prints = arrow_map(whole, _fine, "node long, n long, fine array<long>").join(sig.select("node", "keys"), "node")
        prints = cut(prints.select("node", "n", "keys", "fine"), "nd-fine", "none")
        other = F.col("comp") == F.col("main")
        # every block of members meets every block of queries
        block, turn = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("turns")).cast("int")
        held = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("t")).select("key", (block * F.col("turns") + F.col("t")).alias("block"), F.lit(0).alias("role"), "node", "comp", other.alias("is_main"))
        asked = placed.filter(~other).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("t")).select("key", (F.col("t") * F.col("turns") + turn).alias("block"), F.lit(1).alias("role"), "node", "comp", F.lit(False).alias("is_main"))
        rows = held.unionByName(asked).join(prints, "node").select("key", "block", "role", "node", "comp", "is_main", "n", "keys", "fine")
        rows = rows.repartition(n, "key", "block").sortWithinPartitions("key", "block", "role")
        close = cut(arrow_map(rows, _near(threshold), "key long, block int, part int, role int, node long, comp long, is_main boolean"), "nd-close")
        rows = close.withColumn("block", F.struct("block", "part")).join(whole, "node").join(sig.select("node", "keys", "planes"), "node")
        rows = rows.select("key", F.xxhash64("block").alias("block"), "role", "node", "comp", "is_main", "keys", "planes", "text")
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(n, "key", "block").sortWithinPartitions("key", "block", "role")
        more = cut(arrow_map(rows, _cross(threshold), "a long, b long"), "nd-more")
        if more.limit(1).count():
            comps = cut(components(links.unionByName(more)), "nd-comps")
    labels = classes.join(comps, "node", "left").select("h1", "h2", F.col("node").alias("class_id"), F.coalesce("component", "node").alias("component_id"))
    return sketch.select("doc_id", "n", "h1", "h2"), labels


def groups(docs: DataFrame, *, threshold: int = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept and class_id (the smallest id with an equal set)."""
    sketch, labels = link(docs, threshold=threshold)
    live = F.col("n").cast("boolean") & F.col("doc_id").isNotNull()
    joined = sketch.filter(live).join(labels, ["h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")
    alone = sketch.filter(~live).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    every = joined.unionByName(alone)
    return every.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")


def dedup(docs: DataFrame, *, threshold: int = THRESHOLD) -> DataFrame:
    """Documents without those that a smaller doc_id of their group stands for."""
    gone = groups(docs, threshold=threshold).filter("not kept").select(F.col("doc_id").alias("__nd_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__nd_gone"], "left_anti")


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON s.a = r.b),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY 1),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id
        FROM (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM s GROUP BY 1))
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(w.doc_id, coalesce(c.c, w.doc_id)) AS BIGINT) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(c.c, w.doc_id)) AS kept, CAST(coalesce(cls.class_id, w.doc_id) AS BIGINT) AS class_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = w.doc_id LEFT JOIN cls ON cls.doc_id = w.doc_id
"""
