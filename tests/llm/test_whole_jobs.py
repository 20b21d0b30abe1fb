"""Sizes, hashes and damage that once gave wrong answers, against brute force."""

import hashlib
import random
import re
import struct
import zlib
import struct

import numpy as np
import pyarrow as pa
import pytest
from test_operators import brute_components, docs

from stratalake.llm import common, decontam, license, maxent, neardup, packing, pii, quality, tiff, urlfilter, warc

pytest.importorskip("ahocorasick")


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w


# ------------------------------------------------------------------ word hashes
def test_words_that_a_polynomial_cannot_tell(spark):
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    col = pa.array([f"{a} {b}", f"{b} {a} {a}", "z" * 200 + "q", "z" * 199 + "qz"])
    data, off = common.utf8(col)
    h = common.word_table(data, off)[2]
    assert len(set(h.tolist())) == 4
    tok = packing.tokenizer(packing.tokenizer_path())
    assert [np.frombuffer(x, "<u4").tolist() for x in tok(col)] == [tok.whole(t).tolist() for t in col.to_pylist()]
    sets = neardup.shingle_sets(data, off)
    assert len({int(s[0]) for s in sets}) == 4


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    texts = pa.array(["one two three two", "four one", None, "two"])
    monkeypatch.setattr(packing, "word_table", lambda *a, **k: (lambda s, n, h, c: (s, n, h * 0, c))(*common.word_table(*a, **k)))
    tok = packing.WordTokenizer(packing.tokenizer_path())
    assert [np.frombuffer(x, "<u4").tolist() for x in tok(texts)] == [tok.whole(t or "").tolist() for t in texts.to_pylist()]


def test_a_tokenizer_that_drops_its_pieces(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 3)
    monkeypatch.setattr(packing, "PIECES", 2)
    tok = packing.WordTokenizer(packing.tokenizer_path())
    for texts in (["one two, three", "two. (one)"], ["four two,", None, ""], ["one's five-six", "two three"]):
        assert [np.frombuffer(x, "<u4").tolist() for x in tok(pa.array(texts, pa.string()))] == [tok.whole(t or "").tolist() for t in texts]


def test_what_a_worker_kept_goes_with_the_next_map(monkeypatch):
    kept = {"x": 1}
    monkeypatch.setattr(common, "KEPT", [kept])
    common.begin("a")
    assert not kept
    kept["x"] = 2
    common.begin("a")
    assert kept == {"x": 2}
    common.begin("b")
    assert not kept


# ------------------------------------------------------------------ 1
def test_two_benchmarks_in_turn(spark):
    """Benchmarks that differ in their last item only, each scanned several times by reused workers."""
    base = [(i, f"item number {i} asks about topic{i}") for i in range(60)]
    rows = docs(spark, [(1, "xx question alpha was here"), (2, "xx question omega was here")])
    for turn in range(6):
        last = "question alpha" if turn % 2 else "question omega"
        items = spark.createDataFrame([*base, (99, last)], "item_id int, text string")
        got = {r.doc_id: r.contaminated for r in decontam.report(rows, items).collect()}
        assert got == {1: bool(turn % 2), 2: not turn % 2}


def test_a_window_of_many_items_and_a_long_text(spark):
    items = spark.createDataFrame([(i, "the same words again") for i in range(500)], "item_id int, text string")
    long = "filler " * 300_000 + "the same words again"
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontam.report(docs(spark, [(1, long), (2, "none")]), items, block_windows=64).collect()}
    assert got == {1: (300_004, 4, 500), 2: (1, 0, 0)}


# ------------------------------------------------------------------ 6
def brute_licenses(texts, templates):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    triples = lambda w: [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    held = [(i, n, triples(words(x))) for i, (n, x) in enumerate(templates)]
    held = [(i, n, t, set(t)) for i, n, t in held if t]
    need = {i: set().union(*(own - o for _, m, _, o in held if m != n and len(own & o) >= license.LEAST * len(own))) for i, n, _, own in held}
    out = []
    for text in texts:
        sh, hits = triples(words(text)), {}
        for i, n, t, own in held:
            size = len(t)
            for g in range(-(-len(sh) // size)):
                at = max(0, (g - 1) * size)
                region = sh[at : at + 3 * size + license.SPAN]
                share = len(own & set(region)) / len(own)
                if share >= license.LEAST and need[i] <= set(region):
                    p = frozenset(at + k for k, x in enumerate(region) if x in own)
                    hits[i, n, p] = share
        kept = []
        for (i, n, p), share in sorted(hits.items(), key=lambda x: (-len(x[0][2]), -x[1], x[0][0])):
            if not any(2 * len(q & p) >= len(p) for _, q in kept):
                kept.append((n, p))
        out.append(",".join(sorted({n for n, _ in kept})))
    return out


def test_license_scan_against_brute_force(spark):
    r, noise = random.Random(5), [f"n{k}" for k in range(300)]
    texts = []
    for k in range(40):
        body = r.choices(noise, k=r.randint(0, 200))
        for _ in range(k % 3):
            w = r.choice(license.TEMPLATES)[1].split()
            for _ in range(r.randint(0, len(w) // 25)):
                w[r.randrange(len(w))] = "changed"
            at = r.randint(0, len(body))
            body[at:at] = w
        texts.append(" ".join(body))
    texts += [None, "", "a b", license.TEMPLATES[0][1] * 3, "pad " * 200_000 + license.TEMPLATES[0][1]]
    got = {x.doc_id: x.licenses for x in license.report(docs(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == brute_licenses(texts, license.TEMPLATES)
    assert license.report(docs(spark, [])).count() == 0
    assert license.scan(docs(spark, [(1, "some words here")]), []).count() == 0


@pytest.mark.parametrize("limit", [license.BROADCAST_BYTES, 0])
def test_a_library_of_five_hundred_texts(spark, monkeypatch, limit):
    """300,000 triples; copies with one word in thirty changed are all found, and nothing else, joined either way."""
    monkeypatch.setattr(license, "BROADCAST_BYTES", limit)
    r = random.Random(8)
    words = [f"v{k}" for k in range(5000)]
    library = [(f"L{k:03d}", " ".join(r.choices(words, k=600))) for k in range(500)]
    rows = []
    for k in range(0, 500, 10):
        w = library[k][1].split()
        for i in range(k % 30, 600, 30):
            w[i] = "changed"
        rows.append((k, " ".join([*r.choices(words, k=50), *w, *r.choices(words, k=50)])))
    rows += [(1000 + k, " ".join(r.choices(words, k=700))) for k in range(20)]
    got = {(x.doc_id, x.license) for x in license.scan(docs(spark, rows), library).collect()}
    assert got == {(k, f"L{k:03d}") for k in range(0, 500, 10)}


# ------------------------------------------------------------------ 9
def tiff_of(width, height, compression=1, data=b"\0" * 64, rows=None):
    tags = [(256, 4, width), (257, 4, height), (258, 3, 8), (259, 3, compression), (277, 3, 1), (273, 4, 8), (278, 4, rows or height), (279, 4, len(data))]
    out = struct.pack("<2sHI", b"II", 42, 8 + len(data)) + data + struct.pack("<H", len(tags))
    for tag, kind, v in sorted(tags):
        out += struct.pack("<HHI", tag, kind, 1) + (struct.pack("<I", v) if kind == 4 else struct.pack("<HH", v, 0))
    return out + b"\0" * 4


def test_damaged_images_give_error_rows(spark):
    whole = tiff.encode([np.arange(64, dtype=np.uint8).reshape(8, 8)], tiff.LZW, 1)
    rows = [("ok", tiff_of(8, 8)), ("none", tiff_of(0, 8)), ("wide", tiff_of(1 << 31, 1)), ("high", tiff_of(8, 1 << 31)), ("bomb", tiff_of(60_000, 60_000, 8)), ("blocks", tiff_of(8, 8, rows=2)), ("flat", tiff_of(8, 0)), ("null", None)]
    r = random.Random(2)
    for k in range(150):
        bad = bytearray(whole)
        for _ in range(1 + k % 3):
            bad[r.randrange(len(bad))] = r.randrange(256)
        rows.append((f"noise{k}", bytes(bad)))
    got = {}
    for x in tiff.pages(spark.createDataFrame(rows, "k string, media binary"), keep=["k"]).collect():
        got.setdefault(x.k, []).append((x.pixels, x.error))
    assert got["ok"] == [(bytearray(64), None)] and got["none"] == got["flat"] == [(bytearray(), None)] and "null" not in got
    assert all(p is None and e for k in ("wide", "high", "bomb", "blocks") for p, e in got[k])
    assert all(f"noise{k}" in got for k in range(150))
    assert tiff.pages(spark.createDataFrame([], "k string, media binary")).count() == 0


def test_every_stored_form_comes_back(spark):
    r = random.Random(4)
    texts = ["".join(r.choices("ab é\U0001f600", k=r.randint(0, 900))) for _ in range(300)] + ["x" * 700_000, "y z " * 150_000, None, ""]
    pad = lambda t: (t or "").encode().ljust(max(64, -(-len((t or "").encode()) // 64) * 64), b"\0")
    assert {zlib.crc32(pad(t)) % len(tiff.FORMS) for t in texts} == set(range(len(tiff.FORMS)))
    kept = tiff.fingerprint(tiff.store(docs(spark, list(enumerate(texts)))))
    got = {x.doc_id: x for x in tiff.digests(tiff.pages(kept, "media", keep=["doc_id", "n_bytes", "media_bytes", "media_sha256"])).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert (got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(pad(t)), hashlib.sha256(pad(t)).hexdigest(), zlib.crc32(pad(t)[-64:]))
        assert (got[i].media_bytes, got[i].media_sha256) == (len(tiff.stored(pad(t))), hashlib.sha256(tiff.stored(pad(t))).hexdigest())


# ------------------------------------------------------------------ 10
def test_archives_of_copies_and_odd_urls(spark):
    """One body in a third of the rows, others null or tiny, ids in falling order, files rolled at every record."""
    hot, other = "<p>" + "hot " * 100, "<p>" + "other é " * 60
    urls = ["http://a/%20 b", "http://a/%2520", "", None, "http://x/\r\nX-Evil: 1", "http://é/%", "http://plain/?q=%C3"]
    rows = [(500 - i, urls[i % 7], [hot, other, None, "tiny", "z" * 99, "z" * 100][i % 6]) for i in range(300)]
    rows += [(None, "u", hot), (7, "u", hot), (500, "twice", hot), (-3, "n", other), (1000, "long", "q" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    idx = warc.index(warc.write(pages, roll=2000)).collect()
    assert {(x.page_id, x.url) for x in idx} == {(i, u) for i, u, _ in rows} and len(idx) == len(rows)
    least = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            least[h] = min(i, least.get(h, i))
    want = []
    for i, _, h in rows:
        first = least.get(h) if i is not None else None
        again = first is not None and first != i
        want.append((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if again else "response", first if again else None))
    got = [(x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in warc.report(pages).collect()]
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(got, key=key) == sorted(want, key=key)


# ------------------------------------------------------------------ 3
def family(n, changed, length=120, seed=6, first=0):
    r = random.Random(seed)
    base, rows = [f"b{k}" for k in range(length)], []
    for i in range(n):
        w = list(base)
        for at in r.sample(range(length), changed):
            w[at] = f"e{i}-{at}"
        rows.append((first + i, " ".join(w)))
    return rows


def test_sketch_of_one_bit():
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64))
    for share in (100, 300, 450):
        b = np.concatenate([a[:share], np.unique(np.random.default_rng(2).integers(0, 1 << 63, 500 - share, dtype=np.uint64))])
        assert abs(neardup.fine_estimates(neardup.fine(a), neardup.fine(b)[None])[0] - share / (1000 - share)) < 0.07
    assert neardup.fine_floor(85) > 0.76


def test_similar_texts_under_the_threshold_send_no_text(spark, monkeypatch):
    """A hot family of similarity about 0.67 has no links; its texts stay where they are. Near ones are still found in it."""
    sent = []
    whole = neardup.cut

    def seen(df, name, *a):
        out = whole(df, name, *a)
        if name == "nd-close":
            sent.append(out.count())
        return out

    monkeypatch.setattr(neardup, "cut", seen)
    rows = family(400, 6)
    got = {x.doc_id: x.component_id for x in neardup.groups(docs(spark, rows)).collect()}
    assert got == {i: i for i, _ in rows} and sum(sent) < 40
    w = rows[17][1].split()
    rows += [(1000, " ".join([*w[:60], "x", *w[61:]])), (1001, " ".join([*w[:90], "y", *w[91:]]))]
    monkeypatch.setattr(neardup, "WIDE", 64)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    got = {x.doc_id: x.component_id for x in neardup.groups(docs(spark, rows)).collect()}
    assert got == {i: (17 if i >= 1000 else i) for i, _ in rows}


def test_links_across_the_components_of_a_bucket(spark, monkeypatch):
    """Chains of changed copies: links that no leader has, with small blocks, against brute force."""
    monkeypatch.setattr(neardup, "WIDE", 32)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    r, rows = random.Random(9), []
    for c in range(4):
        w = [f"c{c}-{k}" for k in range(100)]
        for i in range(40):
            w = list(w)
            w[r.randrange(100)] = f"z{c}-{i}"
            rows.append((c * 100 + i, " ".join(w)))
    r.shuffle(rows)
    want = brute_components(rows)
    assert {x.doc_id: x.component_id for x in neardup.groups(docs(spark, rows)).collect()} == {i: c for i, (_, c) in want.items()}


# ------------------------------------------------------------------ 8
def brute_features(text):
    """Counts of a text's features, by plain loops."""
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode()) if w]
    h = [int(common.word_table(*common.utf8(pa.array([w.decode()])), lower=False)[2][0]) for w in words]
    out, last = [x % quality.WORDS for x in h], []
    for k, x in enumerate(h):
        back = next((g for g in range(1, k + 1) if h[k - g] == x), 0)
        last.append(1 + min(14, back.bit_length() - 1) if back else 0)
    base = 4 * quality.WORDS + quality.PAIRS
    out += [base + x for x in last] + [base + 16 + 16 * x + y for x, y in zip(last, last[1:], strict=False)]
    with np.errstate(over="ignore"):
        out += [4 * quality.WORDS + int(common.mix(np.array([x], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(y))[0] % np.uint64(quality.PAIRS)) for x, y in zip(h, h[1:], strict=False)]
    return sorted(out)


def test_quality_features_against_loops():
    texts = ["a b a b a b", "", "x x x x y", "one", "é ü é\nü é", "a b c d e f g h a b c d e f g h"]
    data, off = common.utf8(pa.array(texts))
    parts, owners = quality.features(data, off)
    f, o = np.concatenate(parts), np.concatenate(owners)
    grams = (f >= quality.WORDS) & (f < 4 * quality.WORDS)
    for k, t in enumerate(texts):
        assert sorted(f[(o == k) & ~grams].tolist()) == brute_features(t)


def test_quality_scores_of_long_texts_and_bounds(spark):
    weights = np.random.default_rng(3).normal(size=quality.BUCKETS).astype(np.float32)
    texts = ["word " * 700_000, "short one", "x" * 3_000_000, ""]
    data, off = common.utf8(pa.array(texts))
    got = quality.scores(data, off, (weights, 0.1))
    for k, t in enumerate(texts):
        alone = quality.scores(*common.utf8(pa.array([t])), (weights, 0.1))
        assert got[k] == pytest.approx(alone[0])
    assert got[3] == pytest.approx(1 / (1 + np.exp(-0.1)))
    d = docs(spark, [(i, f"good words number {i}" if i % 2 else "bad bad bad bad") for i in range(40)] * 2)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in quality.report(d, labels).collect()] == [r.doc_id % 2 for r in d.collect()]
    assert quality.fit(d, labels, sample_bytes=10)[1] == 0.0
    assert quality.report(docs(spark, []), labels).count() == 0


# ------------------------------------------------------------------ 4
def brute_rule(url, rules):
    """(host, path, rule, verdict or None) by trying every rule."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, None)))


@pytest.mark.parametrize("most", [urlfilter.MAX_RULES, 7])
def test_url_rules_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(urlfilter, "MAX_RULES", most)
    r = random.Random(3)
    hosts = ["com", "a.com", "b.a.com", "org", "x.org", "É.org", "a.co"]
    rules = [(r.choice(["allow", "block"]), r.choice(hosts), r.choice(["", "/", "/e", "/en/", "/en/7"])) for _ in range(60)]
    urls = [f"{r.choice(['http', 'HTTPS', ''])}://{r.choice(['', 'www.', 'B.', 'z.b.'])}{r.choice([*hosts, 'A.COM', 'acom'])}{r.choice(['', '/', '/en/78', '/en/7?x=/en/', '#/en/', '?q=://a.com/en/', '/E'])}" for _ in range(400)]
    urls += [None, "", "no host", "://", "a://b://c/d", "x:///en/", "http://com\n/en/7", "http://a.com/" + "e" * 200_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame([*rules, (None, "com", "/"), ("block", None, "/"), ("block", "com", None)], "verdict string, host string, path string")
    for given in (rules, table):
        got = {x.page_id: x for x in urlfilter.judge(pages, rules=given).collect()}
        for i, u in enumerate(urls):
            host, path, rule, verdict = brute_rule(u, rules)
            assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
            assert got[i].verdict == (verdict or ("block" if got[i].score >= urlfilter.CUT else "allow"))
    assert urlfilter.judge(spark.createDataFrame([], pages.schema)).count() == 0


def test_url_model_on_other_hosts():
    """Trained on one draw, held against another: hosts that were never seen, and words that were never seen."""
    def rates(model, rows):
        said = [urlfilter.probability(model, *urlfilter.split_url(u)) >= urlfilter.CUT for u, _ in rows]
        hit = sum(s and y for s, (_, y) in zip(said, rows, strict=True))
        return hit / max(1, sum(said)), hit / sum(y for _, y in rows)

    model = urlfilter.train(urlfilter.labelled())
    seen = {urlfilter.split_url(u)[0] for u, _ in urlfilter.labelled()}
    other = [x for x in urlfilter.labelled(3000, seed=99) if urlfilter.split_url(x[0])[0] not in seen]
    precision, recall = rates(model, other)
    assert precision > 0.95 and recall > 0.9
    r = random.Random(1)
    plain = [(f"http://m.{''.join(r.choices('bcdfglmnprst', k=1))}{''.join(r.choices(['an', 'el', 'or', 'ith', 'en', 'ou'], k=3))}.example.net/en/{k}", 0) for k in range(500)]
    assert sum(urlfilter.probability(model, *urlfilter.split_url(u)) >= urlfilter.CUT for u, _ in plain) < 10


def test_url_table_is_an_input(spark):
    table = spark.createDataFrame([("http://zebra.com/", 1), ("http://zebra.org/a", 1), ("http://lion.com/", 0), ("http://tiger.net/", 0), (None, 1), ("http://x", None)], "url string, label int")
    pages = spark.createDataFrame([(1, "http://www.zebra.de/"), (2, "http://lion.de/")], "page_id long, url string")
    got = {x.page_id: x.verdict for x in urlfilter.judge(pages, table=table).collect()}
    assert got == {1: "block", 2: "allow"}
    assert [x.score for x in urlfilter.judge(pages, table=table.limit(0)).collect()] == [0.5, 0.5]


# ------------------------------------------------------------------ 2
FOUND = [
    ("Mr Smith", "name"), ("John Smith", "name"), ("MR JOHN SMITH", "name"), ("James O'Brien", "name"), ("Mary Smith-Jones", "name"), ("Prof. Angela van der Berg", "name"), ("John F. Kennedy", "name"), ("Анна Петрова", "name"),
    ("Νίκος Παπαδόπουλος", "name"), ("+15551234567", "phone"), ("555.123.4567", "phone"), ("020 7946 0958", "phone"), ("3782 822463 10005", "card"), ("378282246310005", "card"), ("GB82 WEST 1234 5698 7654 32", "iban"), ("DE89370400440532013000", "iban"),
    ("fe80::1ff:fe23:4567:890a", "ipv6"), ("2001:0DB8:85A3:0000:0000:8A2E:0370:7334", "ipv6"), ("221 Baker Street", "address"), ("Hauptstraße 12", "address"), ("élodie.x@foo.fr", "email"),
]


@pytest.mark.parametrize(("mention", "kind"), FOUND)
def test_each_kind_is_found_whole_and_keeps_its_form(mention, kind):
    text = f"see {mention}, there"
    new, spans = pii.replace(text, pii.KEY, {}, {})
    assert [k for k, _, _ in spans] == [kind]
    got = new[spans[0][1] : spans[0][2]]
    assert new == f"see {got}, there" and got != mention
    if kind in ("phone", "card", "iban"):
        assert re.sub(r"\d", "0", re.sub("[A-Z]", "A", got)) == re.sub(r"\d", "0", re.sub("[A-Z]", "A", mention))
    if kind == "iban":
        assert pii._iban(got) and got[:2] == mention[:2]
    if kind == "name":
        assert got.isupper() == mention.isupper() and pii.script(got) == pii.script(mention)
        assert [len(w) for w in got.split() if w in pii.PARTICLES] == [len(w) for w in mention.split() if w in pii.PARTICLES]


def test_what_is_no_entity():
    for t in ("Μαρία και κάτι", "Anna śpi", "Laura šla domov", "at 10:30:15 we met", "The Great Wall", "GB83 WEST 1234 5698 7654 32", "version 1.2.3", "x::y", "Secret garden"):
        assert pii.replace(t, pii.KEY, {}, {}) == (t, []), t


def test_names_stay_coreferent_and_distinct(spark):
    """A family word has one surrogate in all mentions, also where its first one collided; given names never stay."""
    families = sorted({f"{a}{b}{c}" for a in "ABCDEFGHIJ" for b in ("al", "er", "on", "ig") for c in ("ka", "mi", "so", "tt", "un", "ve", "xo", "ya", "zz", "bu", "cy", "da", "fe", "gi", "ho")})
    rows = [(i, f"Mr {f} and John {f}; MARY {f.upper()}") for i, f in enumerate(families)]
    rows += [(5000, "Мария Иванова, Иван Иванов"), (5001, None), (5002, ""), (5003, "word " * 200_000 + "John " + families[0])]
    given = set()
    for block in (pii.BLOCK, 3):
        got = {r.doc_id: r.text for r in pii.rewrite(docs(spark, rows), block=block).collect()}
        seen = set()
        for i, f in enumerate(families):
            a, b, c = re.fullmatch(r"Mr (\w+) and (\w+ \w+); (\w+ \w+)", got[i]).groups()
            assert b.split()[1] == a and c.split()[1] == a.upper() and a not in families
            given |= {b.split()[0], c.split()[0]}
            seen.add(a)
        assert len(seen) == len(families)
        maria, ivan = got[5000].split(", ")
        assert maria.split()[1] == ivan.split()[1] + "а" and maria.split()[0] != "Мария" and ivan.split()[0] != "Иван"
        assert got[5001] is None and got[5002] == "" and got[5003].endswith(got[0].split(" and ")[1].split(";")[0].split()[1])
    assert len(given) == 2 and not given & {"John", "MARY"}
    assert pii.rewrite(docs(spark, [])).count() == 0


def test_numbers_against_brute_force():
    """Every replaced number is the surrogate of its digits, and different numbers stay different."""
    phones = [f"555-{k:03d}-{k * 37 % 10000:04d}" for k in range(1000)]
    new = pii.replace(" ; ".join(phones), pii.KEY, {}, {})[0].split(" ; ")
    assert len(set(new)) == 1000 and all(re.fullmatch(r"\d{3}-\d{3}-\d{4}", x) for x in new)
    assert [x.replace("-", "") for x in new] == [pii.surrogate(pii.KEY, "phone", p.replace("-", "")) for p in phones]


def test_another_lexicon(spark):
    got = pii.rewrite(docs(spark, [(1, "Zorblax Quux met John Smith")]), names={("m", "latin"): ["Zorblax", "Grunk"]}).collect()[0].text
    assert re.fullmatch(r"Grunk \w+ met John Smith", got)


# ------------------------------------------------------------------ 7
def brute_ratio(events):
    """events: (history, class, token or None, before, train, share). The factor of each, by dictionaries."""
    def level(rows, discount):
        n, seen, total = {}, {}, {}
        for ctx, token, train, p in rows:
            if train:
                n[ctx, token] = n.get((ctx, token), 0) + 1
                total[ctx] = total.get(ctx, 0) + 1
        for ctx, token, _, p in rows:
            if token is not None and n.get((ctx, token)):
                seen.setdefault(ctx, {})[token] = p
        out = []
        for ctx, token, _, p in rows:
            own = seen.get(ctx, {})
            used = sum(own.values())
            if used > 1 - 1e-9:
                every = sum(n[ctx, t] for t in own)
                out.append(n[ctx, token] / every / p if token in own else 1.0)
                continue
            q = {t: (n[ctx, t] - discount) / total[ctx] for t in own}
            out.append(q[token] / p if token in own else (1 - sum(q.values())) / (1 - used) if own else 1.0)
        return out

    two = level([((h, c), t, tr, p) for h, c, t, b, tr, p in events], maxent.DISCOUNT)
    three = level([((h, c, b), t, tr, p * r) for (h, c, t, b, tr, p), r in zip(events, two, strict=True)], maxent.DISCOUNT3)
    return [x * y for x, y in zip(two, three, strict=True)]


def test_token_factor_against_loops_and_its_sums():
    r = random.Random(7)
    tokens = {c: list(range(10 * c, 10 * c + r.randint(2, 9))) for c in range(3)}
    share = {}
    for c, ts in tokens.items():
        x = [r.random() for _ in ts]
        share |= {t: 0.8 * y / sum(x) for t, y in zip(ts, x, strict=True)}
    events = []
    for _ in range(400):
        c = r.randrange(3)
        t = r.choice([*tokens[c][: 1 + r.randrange(len(tokens[c]))], None])
        events.append((r.randrange(4), c, t, r.randrange(3), r.random() < 0.8, share.get(t, 0.0)))
    ask = [(h, c, t, b, False, share.get(t, 0.0)) for h in range(5) for c in tokens for b in range(4) for t in [*tokens[c], None]]
    events += ask
    h, c, t, b, tr, p = zip(*events, strict=True)
    code = [x if x is not None else maxent.HOT + y for x, y in zip(t, c, strict=True)]
    got = maxent.ratios(np.array(h, np.uint32), np.array(c, np.int64), np.array(code, np.uint32), np.array(b, np.uint32), np.array(tr), np.array(p))
    assert got == pytest.approx(brute_ratio(events))
    sums = {}
    for (h, c, t, b, _, p), x in zip(ask, got[-len(ask) :], strict=True):
        # a class's other tokens hold what the shares leave, 0.2 here
        sums[h, c, b] = sums.get((h, c, b), 0.0) + (p if t is not None else 0.2) * x
    assert set(sums) and all(x == pytest.approx(1) for x in sums.values())


def test_token_factor_where_a_class_is_seen_whole():
    n = 6
    got = maxent.ratios(np.zeros(n, np.uint32), np.zeros(n, np.int64), np.array([0, 0, 1, 0, 1, 1], np.uint32), np.zeros(n, np.uint32), np.array([True, True, True, False, False, True]), np.array([0.5] * n))
    assert got == pytest.approx([1.0] * n)


def test_language_model_end_to_end(spark, monkeypatch):
    """score against the model's own parts, token by token; chunks and partitions do not matter."""
    r = random.Random(12)
    rows = [(i, " ".join(r.choice([f"w{k}", f"w{k % 5}"]) for k in r.choices(range(30), k=r.randint(0, 25)))) for i in range(120)]
    rows += [(500, None), (501, "never seen w1"), (None, "w1 w2"), (3, rows[3][1])]
    d = docs(spark, rows)
    _, (total, distinct), v, w, bias, logs = maxent.fit(d)
    events, where, want = [], [], {}
    for k, (i, text) in enumerate(rows):
        t = maxent.Tokens(*common.utf8(pa.array([text or ""])))
        at, cls = maxent.classes_of(v, t)
        z, _, sums = maxent.softmax(w, bias, maxent.features(t))
        train = i is None or zlib.crc32(str(i).encode()) % 7 != 2
        prev, before = t.before(t.h, maxent.START), t.before(t.before(t.h, maxent.START), maxent.START)
        want[k] = 0.0
        for j in range(len(t.h)):
            own = at[j] >= 0
            share = (v.c[at[j]] + 1 if own else 1) / 10 ** logs[cls[j]]
            want[k] += (z[j, cls[j]] - np.log(sums[j, 0])) / np.log(10) + np.log10(share)
            events.append((int(prev[j]), int(cls[j]), int(at[j]) if own else None, int(before[j]), train, share if own else 0.0))
            where.append(k)
    for k, x in zip(where, brute_ratio(events), strict=True):
        want[k] += np.log10(x)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    expect = sorted([(i, want[k]) for k, (i, _) in enumerate(rows)], key=key)

    def check(frame):
        got = sorted([(x.doc_id, x.score) for x in maxent.score(frame).collect()], key=key)
        assert [i for i, _ in got] == [i for i, _ in expect] and [x for _, x in got] == pytest.approx([x for _, x in expect], rel=1e-2)

    check(d)
    monkeypatch.setattr(maxent, "CHUNK", 40)
    check(d.repartition(7))


def test_language_model_without_rows(spark):
    assert maxent.score(docs(spark, [])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (x,) = maxent.score(docs(spark, [(held, "no training at all")])).collect()
    assert (x.train_tokens, x.n_known, x.n_tokens) == (0, 0, 5) and x.base_score == 0.0 and np.isfinite(x.score)


def test_held_out_gain_and_partitions(spark):
    """At least 0.3 log10 a token over the base on held-out rows, and the same at 1 and 64 partitions."""
    d, got = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), []
    for n in (1, 64):
        x = maxent.score(d.repartition(n)).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
        got.append(x.s / x.n)
        assert (x.s - x.b) / x.n > 0.3
    assert abs(got[0] - got[1]) < 0.01


@pytest.mark.parametrize("shards", [1, 64, 65, 200])
def test_tokens_go_to_any_number_of_shards(spark, monkeypatch, shards):
    """Whatever the number of shards that a chunk fills, every token arrives once."""
    rows = [(i, " ".join(f"t{i * 7 + k}" for k in range(40))) for i in range(60)]
    d = docs(spark, rows)
    counts, _, v, _, _, logs = maxent.fit(d)
    src = d.selectExpr("xxhash64(doc_id, text) AS key", "true AS train", "text").coalesce(1)
    n = sum(len(t.split()) + 1 for _, t in rows)
    monkeypatch.setattr(maxent, "SHARD", -(-n // shards))
    got = {x.key: x.ratio for x in maxent.token_factor(src, v, logs, n, len(rows)).collect()}
    assert len(got) == len(rows) and all(x > 0 for x in got.values())


def test_frequent_histories_learn_from_the_whole_text(spark, monkeypatch):
    """Whatever a shard holds, a previous token that stands too often for one has the weights of all its training text."""
    r = random.Random(31)
    rows = [(i, " ".join(r.choice(["a", "a", "b", f"w{r.randrange(25)}"]) for _ in range(r.randint(0, 40)))) for i in range(150)]
    rows += [(700 + i, "a a a b a a") for i in range(40)] + [(None, None), (900, "never seen a b")]
    d = docs(spark, rows)
    counts, _, v, _, _, logs = maxent.fit(d)
    src = d.selectExpr("xxhash64(doc_id, text) AS key", "coalesce(crc32(cast(doc_id AS string)), 0) % 7 != 2 AS train", "text").repartition(5)
    n = sum(len((t or "").split()) + 1 for _, t in rows)
    ratios = lambda: {x.key: x.ratio for x in maxent.token_factor(src, v, logs, n, len(rows)).collect()}
    whole = ratios()
    for shard in (1000, 300, 40):
        monkeypatch.setattr(maxent, "SHARD", shard)
        often, tables = maxent.frequent(src.filter("train").select("text"), v, len(rows))
        assert (len(often) > 0, len(often.pairs) > 0) == (True, True) and len(tables) == 2
        assert ratios() == pytest.approx(whole, rel=1e-4, abs=1e-3)


def test_all_kinds_of_features_learn_from_every_minibatch(spark):
    r = random.Random(5)
    d = docs(spark, [(i, " ".join(r.choice(["one", "2", "three.", "vier"]) for _ in range(30))) for i in range(40)]).coalesce(1)
    before, after = (maxent.fit(d, rounds=k)[3].reshape(maxent.FEATURES, -1) for k in (0, 1))
    assert (before != after).any(axis=1).all()


# ------------------------------------------------------------------ pipeline
def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empties, repeats, a very long text and an empty table go through all stages."""
    import corpus_pipeline

    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "x", 0), (None, "one two three", None, "y", 13), (9003, "word " * 100_000, "en", "z", 1), (9003, "word " * 100_000, "en", "z", 1)], whole.schema)
    for name, rows in (("odd", whole.unionByName(odd)), ("none", whole.limit(0))):
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{name}/{t}.parquet")
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        got = out.collect()
        assert "ids" in out.columns and all(len(r.ids) == 4 * r.length for r in got)
        assert bool(got) == (name == "odd")
