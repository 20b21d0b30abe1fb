"""Benchmark decontamination with one Aho-Corasick automaton.

The normalised benchmark texts (questions, answers: any text columns) are cut into
windows of `width` consecutive words; an item with fewer words is one window. Every
document is normalised once, scanned once, and each match is mapped back to word
numbers and to byte offsets of the original text.

Defined results: null or empty text has no words and no hits. An item whose id or
text is null, or that has no words, has no windows. Repeated items and documents are
each handled as they come; an item id counts once per document. Other columns are
not read, so their names cannot clash.

Scale: no shuffle of documents. The automaton is the only shared state. The windows
are written to the shared folder and travel in blocks of about `block_windows`: driver and broadcast hold one block at a time. A benchmark of
one block has one automaton and one scan; each further block is one more automaton and
one more scan, with the hits of earlier blocks carried along in a column.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.llm.common import KEPT, arrow_map, cut, raw_texts

WIDTH = 10
BLOCK_WINDOWS = 200_000

#: A-Z to a-z; every other ASCII character outside 0-9a-z to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


def windows(raw: bytes, width: int) -> list[bytes]:
    w = words(raw)
    if not w:
        return []
    return [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]


def item_windows(items: DataFrame, id_col: str, text_cols: Sequence[str], width: int, block: int) -> list[DataFrame]:
    """Distinct (window, item) rows in blocks of about `block` rows, a window whole in one block; made and kept on the executors."""

    def emit(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            out = [(i, w) for c in range(1, b.num_columns) for i, raw in zip(ids, raw_texts(b.column(c)), strict=True) if i is not None for w in set(windows(raw, width))]
            yield pa.RecordBatch.from_arrays([pa.array([w for _, w in out], pa.binary()), pa.array([i for i, _ in out], pa.string())], ["window", "item"])

    src = items.select(F.col(id_col).cast("string").alias("item"), *[F.col(c).alias(f"t{k}") for k, c in enumerate(text_cols)])
    # a window with its item is one row, so a window that many items share is no group
    flat = cut(arrow_map(src, emit, "window binary, item string").distinct(), "dc-windows")
    n = max(1, -(-flat.count() // block))
    part = F.pmod(F.xxhash64("window"), F.lit(n))
    return [flat.filter(part == k) for k in range(n)]


class Matcher:
    """One automaton over ' w1 .. wn ' patterns; bytes stand for themselves as Latin-1 characters."""

    def __init__(self, block: list[tuple[bytes, str]]):
        import ahocorasick

        items: dict[bytes, list[str]] = {}
        for w, i in block:
            items.setdefault(w, []).append(i)
        self.items = list(items.values())
        self.width = [w.count(b" ") + 1 for w in items]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, w in enumerate(items):
            self.automaton.add_word(f" {w.decode('latin-1')} ", k)
        if self.items:
            self.automaton.make_automaton()

    def find(self, doc: list[bytes]) -> list[tuple[int, int, int]]:
        """(first word, end word, window) of every occurrence."""
        text = f" {b' '.join(doc).decode('latin-1')} "
        hits = list(self.automaton.iter(text)) if doc and self.items else []
        if not hits:
            return []
        spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
        last = np.searchsorted(spaces, [e for e, _ in hits]) - 1
        return [(int(j) - self.width[k] + 1, int(j) + 1, k) for j, (_, k) in zip(last, hits, strict=True)]


_matchers: dict[str, Matcher] = {}
KEPT.append(_matchers)


def _matcher(shared) -> Matcher:
    """Built once per worker process and block; only the latest is kept."""
    if shared.id not in _matchers:
        _matchers.clear()
        _matchers[shared.id] = Matcher(shared.value)
    return _matchers[shared.id]


class _Shared:
    """A broadcast with an id of its own that survives pickling."""

    def __init__(self, spark, value):
        self.cast, self.id = spark.sparkContext.broadcast(value), uuid.uuid4().hex

    @property
    def value(self):
        return self.cast.value


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def byte_spans(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as byte ranges of the original text (folding keeps every byte in place)."""
    folded = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
    edge = np.diff(folded.astype(np.int8), prepend=0, append=0)
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(int(first[a]), int(end[b - 1])) for a, b in spans]


SPAN = "array<struct<first_word:long,end_word:long,first_byte:long,end_byte:long>>"


def scan(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_texts: Sequence[str] = ("text",), width: int = WIDTH, block_windows: int = BLOCK_WINDOWS, keep: Sequence[str] | None = None) -> DataFrame:
    """The columns `keep` of each document (default: all) with dc_words, dc_spans (merged hit spans) and dc_items (sorted item ids)."""
    spark = docs.sparkSession
    blocks = item_windows(items, item_id, item_texts, width, block_windows)
    keep = list(docs.columns if keep is None else keep)
    base = [f for f in docs.schema if f.name in keep]
    schema = T.StructType([*base, T.StructField("dc_words", T.LongType()), T.StructField("dc_spans", T._parse_datatype_string(SPAN)), T.StructField("dc_items", T.ArrayType(T.StringType()))])
    df = docs.select(*[F.col(f"`{c}`") for c in keep]) if text_col in keep else docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("dc_text"))
    names, text_at = [f.name for f in base], keep.index(text_col) if text_col in keep else len(keep)
    carry = text_col not in keep
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        out_schema = schema if last or not carry else T.StructType([*base, T.StructField("dc_text", T.StringType()), *schema.fields[len(base) :]])
        rows = [(bytes(w), i) for w, i in block.toLocalIterator()]
        df = arrow_map(df, _scanner(_Shared(spark, rows), len(base), text_at, k > 0, carry and not last), out_schema)
    assert names == keep
    return df


def _scanner(shared: _Shared, n_base: int, text_at: int, later: bool, carry: bool):
    span_type = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("first_byte", pa.int64()), ("end_byte", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(shared)
        for b in batches:
            n_words, spans, items = [], [], []
            old = (b.column(b.num_columns - 2), b.column(b.num_columns - 1)) if later else None
            col = b.column(text_at)
            for at in range(0, len(col), 256):
                for k, raw in enumerate(raw_texts(col.slice(at, 256)), at):
                    doc = words(raw)
                    n_words.append(len(doc))
                    hits = m.find(doc)
                    ws, ids = [(a, e) for a, e, _ in hits], {i for _, _, w in hits for i in m.items[w]}
                    if old:
                        ws += [(s["first_word"], s["end_word"]) for s in old[0][k].as_py()]
                        ids |= set(old[1][k].as_py())
                    ws = _merge(ws)
                    spans.append([dict(zip(("first_word", "end_word", "first_byte", "end_byte"), (*w, *s), strict=True)) for w, s in zip(ws, byte_spans(raw, ws) if ws else (), strict=True)])
                    items.append(sorted(ids))
            cols = [b.column(i) for i in range(n_base)] + ([col] if carry else [])
            names = [b.schema.names[i] for i in range(n_base)] + (["dc_text"] if carry else [])
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(spans, span_type), pa.array(items, pa.list_(pa.string()))], [*names, "dc_words", "dc_spans", "dc_items"])

    return run


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Documents without any occurrence of a benchmark window, with their columns as they came."""
    return scan(docs, items, **options).filter(F.size("dc_spans") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The contract's row per document."""
    hits = scan(docs, items, keep=["doc_id"], **options)
    n_hit = F.aggregate("dc_spans", F.lit(0).cast("long"), lambda a, s: a + s["end_word"] - s["first_word"])
    return hits.select(
        "doc_id",
        F.col("dc_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "dc_items"), 256).alias("items_sha256"),
        (F.size("dc_spans") > 0).alias("contaminated"),
    )


SQL = """
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
places AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM docs, (SELECT DISTINCT m FROM item_windows) WHERE len(w) >= m)),
hits AS (SELECT doc_id, i, p.m, item FROM places p JOIN item_windows USING (m, win)),
hit_words AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(m)) AS k FROM hits) GROUP BY 1),
hit_items AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)
"""
