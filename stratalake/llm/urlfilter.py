"""URL filter: host and path rules, and logistic regression on hashed character n-grams.

Host and path are cut out on the JVM. A rule fits its host and all subdomains where
the path starts with the rule's path; the longest fitting rule decides. Other URLs
are judged by a logistic regression over hashed character n-grams of host and path,
trained from a small labelled URL table (url, label; 1 is block). Of a larger table
the MAX_LABELLED rows with the smallest hash are learned from. `labelled` makes the
table that is used where none is given: names that sites of the two kinds have, in
usual shapes.

Defined results: a null URL, or one without "://", has empty host and path, fits no
rule and is judged on the model's bias; among fitting rules of one length the
blocking one decides; a URL or rule that repeats is judged each time; rules with a null
host or path fit nothing; null urls or labels are not learned from; an empty table gives
no row, an empty labelled table the score 0.5; extra columns are not read.

Scale: maps without shuffle. Rules travel in blocks of about `MAX_RULES`; each block is
one pass over (host, path), with the best rule so far carried along, so any number of
rules goes the same way and no host suffix is a key.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.common import arrow_map, cut

BUCKETS, GRAMS = 1 << 15, (3, 4, 5)
MAX_LABELLED, MAX_RULES = 10_000, 100_000
EPOCHS, RATE, MOMENTUM, DECAY, CUT = 300, 6.0, 0.95, 1e-5, 0.5

#: (verdict, host, path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

# words that names of sites to block are made of, and words that are often in others
BAD = "casino poker jackpot betting gambling slots roulette xxx porn adult sexcam escort hookup singles viagra cialis pills pharmacy steroid torrent warez keygen crack nulled payday loan replica counterfeit free-money get-rich prize lottery winner spam seo-links link-farm clickbait phishing malware fake-id darkweb scam".split()
GOOD = "news blog docs library school museum science recipes weather history garden research wiki journal forum shop travel music health sport city university college hospital bank post radio theatre photo design code data open green river mountain house family kitchen market print paper art book film".split()
_SYLLABLES = "ba be bi bo bra cal can car che co con da de del den di dor el en er es fa fel fen fi for ga gen ger go ha hel her hin in is ja jo ka kel ken ko la lan le len li lin lo lu ma man mar me men mi mo na ne ner ni no nor o on or pa par pe pen po ra re ren ri ro sa san se ser sha si son sta ste su ta tan te ter th the ti to tor tra u un ur va ver vi vo wa wen wi ya zen".split()
_TAILS = ["com", "org", "net", "example.com", "example.org", "example.net", "de", "co.uk", "info", "fr"]
_HEADS = ["", "www.", "m.", "blog.", "en.", "static."]


def labelled(n: int = 4000, seed: int = 11, bad: list[str] = BAD, good: list[str] = GOOD) -> list[tuple[str, int]]:
    """A small labelled table (1: block), from a rule: one host in four is made with a word of the first list."""
    r, out = random.Random(seed), []

    def invented() -> str:
        return "".join(r.choices(_SYLLABLES, k=r.randint(2, 4)))

    def path(words: list[str]) -> str:
        return r.choice(["", "/", f"/{r.randint(1, 9999)}", f"/{r.choice(['en', 'de', 'fr', 'es', 'it'])}/{r.randint(1, 9999)}{r.choice(['', '/', '.html'])}", f"/{r.choice(words)}/{invented()}.html", f"/articles/{r.randint(1990, 2025)}/{invented()}-{invented()}", f"/index.php?id={r.randint(1, 999)}"])

    for k in range(n):
        y = int(k % 4 == 0)
        word = r.choice(bad if y else good)
        other = r.choice([invented(), r.choice(good), str(r.randint(1, 999))])
        sep = r.choice(["-", "", "-"])
        name = r.choice([word, f"{word}{sep}{other}", f"{other}{sep}{word}", f"{word}-{r.choice(['win', 'x', 'online', 'best', '24', 'hub'])}"]) if y or r.random() < 0.3 else r.choice([invented(), invented(), f"{invented()}-{invented()}"])
        out.append((f"{r.choice(['http', 'https'])}://{r.choice(_HEADS)}{name}.{r.choice(_TAILS)}{path(bad if y else good)}", y))
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """The same cut as `parts`, for training rows."""
    import re

    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")


def grams(host: str, path: str) -> list[int]:
    """Buckets of n-grams of the host and of the path, told apart and with marked ends."""
    out = []
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        if len(text) > 2:
            out += [zlib.crc32(f"{kind}{text[i : i + n]}".encode()) % BUCKETS for n in GRAMS for i in range(len(text) - n + 1)]
    return out


def train(rows: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent with momentum on unit-length count vectors."""
    if len(rows) > MAX_LABELLED:
        rows = sorted(rows, key=lambda x: (zlib.crc32(x[0].encode()), x))[:MAX_LABELLED]
    ids, val, at = [], [], []
    for k, (url, _) in enumerate(rows):
        u, c = np.unique(np.array(grams(*split_url(url)), np.int64), return_counts=True)
        ids.append(u)
        val.append(c / max(1e-9, np.linalg.norm(c)))
        at.append(np.full(len(u), k))
    w, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return w, bias
    ids, val, at = map(np.concatenate, (ids, val, at))
    y = np.array([v for _, v in rows], float)
    step, lean = np.zeros(BUCKETS), 0.0
    for _ in range(EPOCHS):
        g = (1 / (1 + np.exp(-(np.bincount(at, val * w[ids], len(y)) + bias))) - y) / len(y)
        step = MOMENTUM * step - RATE * (np.bincount(ids, val * g[at], BUCKETS) + DECAY * w)
        lean = MOMENTUM * lean - RATE * g.sum()
        w, bias = w + step, bias + lean
    return w, bias


def parts(pages: DataFrame) -> DataFrame:
    """page_id, host and path; the host is lower-cased over A-Z only."""
    find = lambda k: F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return pages.select("page_id", F.translate(find(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), find(2).alias("path"))


def _name(host: str, path: str) -> str:
    return host + path


class Rules:
    def __init__(self, rules: list[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[int, bool, str, str, str]]] = {}
        for verdict, host, path in rules:
            name = _name(host, path)
            self.by_host.setdefault(host, []).append((len(name), verdict == "block", name, verdict, path))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, at = None, 0
        while host and at >= 0:
            for rule in self.by_host.get(host[at:], ()):
                if path.startswith(rule[4]) and (best is None or rule[:2] > best[:2]):
                    best = rule
            at = host.find(".", at) + 1 or -1
        return best and (best[2], best[3])


def probability(model: tuple[np.ndarray, float], host: str, path: str) -> float:
    """The model's probability of block."""
    w, bias = model
    u, c = np.unique(np.array(grams(host, path), np.int64), return_counts=True)
    return float(1 / (1 + np.exp(-(bias + (w[u] @ c / np.linalg.norm(c) if len(u) else 0.0)))))


def _judge(shared, first: bool):
    """Scores each URL (in the first pass) and takes its best rule of this block, or the one it came with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, model = shared.value
        for b in batches:
            host, path = b.column(1).to_pylist(), b.column(2).to_pylist()
            best = [rules.find(h, p) for h, p in zip(host, path, strict=True)]
            if first:
                scores = pa.array([probability(model, h, p) for h, p in zip(host, path, strict=True)], pa.float64())
            else:
                scores = b.column(5)
                for k, (name, verdict) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                    if name is not None and (best[k] is None or (len(name), verdict == "block") > (len(best[k][0]), best[k][1] == "block")):
                        best[k] = (name, verdict)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([x and x[0] for x in best], pa.string()), pa.array([x and x[1] for x in best], pa.string()), scores], ["page_id", "host", "path", "rule", "fixed", "score"])

    return run


def _blocks(rules: list[tuple[str, str, str]] | DataFrame) -> Iterator[list[tuple[str, str, str]]]:
    """The rules, about MAX_RULES at a time."""
    if isinstance(rules, DataFrame):
        kept = cut(rules.select("verdict", "host", "path").filter("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL"), "url-rules")
        n = max(1, -(-kept.count() // MAX_RULES))
        for k in range(n):
            yield [tuple(r) for r in kept.filter(F.pmod(F.xxhash64("host", "path"), F.lit(n)) == k).toLocalIterator()]
    else:
        for i in range(0, max(1, len(rules)), MAX_RULES):
            yield rules[i : i + MAX_RULES]


def judge(pages: DataFrame, *, rules: list[tuple[str, str, str]] | DataFrame = RULES, table: list[tuple[str, int]] | DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score (probability of block). rules: (verdict, host, path); table: (url, label)."""
    spark = pages.sparkSession
    if isinstance(table, DataFrame):
        few = table.select("url", F.col("label").cast("int").alias("label")).dropna().orderBy(F.xxhash64("url"), "url", "label").limit(MAX_LABELLED)
        table = [(r[0], r[1]) for r in few.collect()]
    model = train(labelled() if table is None else table)
    kind = dict(pages.select("page_id").dtypes)["page_id"]
    out, first = parts(pages), True
    for block in _blocks(rules):
        shared = spark.sparkContext.broadcast((Rules(block), model if first else None))
        out = arrow_map(out, _judge(shared, first), f"page_id {kind}, host string, path string, rule string, fixed string, score double")
        first = False
    verdict = F.coalesce("fixed", F.when(F.col("score") >= CUT, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def report(pages: DataFrame) -> DataFrame:
    return judge(pages)
