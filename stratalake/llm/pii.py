"""PII surrogates: keyed, type-consistent, distinct and coreferent replacements.

Entities are found by patterns and by a lexicon of given names: e-mail addresses, IBANs,
telephone and card numbers, IPv4 and IPv6 addresses, street addresses, access keys,
secret assignments, and personal names after a title or with a given name of the
lexicon (which is a parameter), in any script with capitals and in capitals throughout.
A surrogate depends on the key, the type and the normalised entity alone, so mentions
agree in all documents. Digits are replaced under a keyed permutation of the numbers of
the same format (a Feistel network), so different numbers stay different; cards and IBANs
keep valid check digits. Names are replaced word by word: given names by the next
in a keyed cycle of the lexicon's names of their gender and script, initials by one of
the letters, all other words (family names) by invented ones of their script, with the
feminine ending where they have one. So "Mr Smith", "John Smith" and "SMITH" after a
title share a surrogate, and full names stay distinct as their words do.

Collision check: the distinct entities of the corpus (of names, the family words) are
gathered, their surrogates compared with each other and with the entities, and every
entity but the smallest of a colliding group (and every entity whose surrogate is itself
an entity) takes its next attempt, until none is left. Only these exceptions, with their
attempts, go back to the texts, broadcast in blocks of at most `BLOCK` entities: the
last block in the pass that rewrites, each further one in a pass that notes which of its
entities a text holds.

Defined results: null text stays null, empty text stays empty; overlapping finds go to
the one that starts first, then to the type listed first; documents and ids that repeat
are each rewritten; an empty table gives no row; very long texts are handled one by one;
all other columns are handed on untouched. Not found: names without title whose given
name the lexicon lacks, single names without title, numbers spelled out.

Scale: two maps over the texts, and one partial aggregation and shuffle of distinct
entities; the hottest entity is one row per partition.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.llm.common import arrow_map, cut

KEY = b"surrogates-1"
BLOCK = 200_000
MAX_ATTEMPTS = 64

# the default lexicon: given names that are not common words
NAMES = {
    ("m", "latin"): "James Robert Michael Thomas Daniel Peter Carlos Pierre Stefan Marco Javier Lukas John David William Richard Joseph Charles Christopher Matthew Anthony Andrew Paul Steven Kevin Brian George Edward Hans Klaus Jürgen Wolfgang Heinrich Matthias Andreas Jean Jacques François Philippe Antoine José Juan Luis Miguel Pedro Diego Giovanni Giuseppe Luca Paolo Jan Piotr Tomasz Jakub Erik Lars Sven Ahmed Mohammed Ali".split(),
    ("f", "latin"): "Mary Anna Laura Julia Sofia Elena Claire Monika Carmen Emily Lucia Ingrid Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Emma Olivia Hannah Ursula Petra Sabine Katrin Greta Marie Sophie Camille Juliette Hélène Isabel María Maria Ana Pilar Dolores Chiara Giulia Francesca Agnieszka Katarzyna Małgorzata Zofia Eva Astrid Kristina Fatima Aisha Leila Angela".split(),
    ("m", "cyrillic"): "Иван Сергей Дмитрий Николай Андрей Павел Михаил Олег Александр Алексей Владимир Виктор Юрий Игорь Борис Григорий".split(),
    ("f", "cyrillic"): "Анна Ольга Елена Мария Наталья Ирина Татьяна Светлана Екатерина Людмила Галина Юлия Марина Оксана Дарья Ксения".split(),
    ("m", "greek"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παναγιώτης Βασίλης Θανάσης".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Γεωργία Βασιλική Δήμητρα Ιωάννα".split(),
}
SYLLABLES = {
    "latin": ["bar", "del", "fon", "gar", "hol", "jen", "kel", "lam", "mor", "nev", "pol", "ras", "sim", "tor", "val", "win"],
    "cyrillic": ["бар", "вел", "гор", "дан", "жар", "зим", "кол", "лав", "мир", "нов", "пол", "рад", "сол", "тар", "фед", "чер"],
    "greek": ["βαρ", "γαλ", "δελ", "ζαν", "θεο", "καλ", "λαμ", "μαρ", "νικ", "παπ", "ραλ", "σαρ", "τζα", "φιλ", "χατ", "ψαρ"],
}
TITLES = "Mr Mrs Ms Miss Dr Prof Doctor Professor Herr Frau Monsieur Madame Señor Señora Sr Sra Signor Signora Pan Pani Господин Госпожа Κύριος Κυρία".split()
PARTICLES = "van von de der den da di del della la le bin al el dos du zu".split()
#: feminine and masculine endings of family names
ENDINGS = [("ская", "ский"), ("цкая", "цкий"), ("ова", "ов"), ("ева", "ев"), ("ska", "ski"), ("cka", "cki"), ("ová", "")]

_UP = "".join(chr(c) for c in [*range(0x41, 0x530), *range(0x1E00, 0x2000)] if unicodedata.category(chr(c)) in ("Lu", "Lt"))
_WORD = rf"[{_UP}][^\W\d_]*(?:['’\-](?=[{_UP}])[^\W\d_]+)*"
#: Words with capitals side by side; particles and initials may stand between.
_RUN = re.compile(rf"(?<![\w'’\-]){_WORD}\.?(?:[ \u00a0](?:(?:{'|'.join(PARTICLES)})[ \u00a0])*(?:[{_UP}]\.[ \u00a0])*{_WORD})+")
_TOKEN = re.compile(r"[^ \u00a0]+")
_titles = {t for w in TITLES for t in (w, w.upper())}

#: Keywords in any case; a class for each first letter lets the search pass over other places quickly.
_SECRET = "(?:[Pp](?ai:assword|asswd)|[Ss](?ai:ecret)|[Tt](?ai:oken)|[Aa](?ai:pi_key))"
_ROAD = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Terrace|Square"

PATTERNS = [
    ("email", r"[\w.%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"),
    ("secret", _SECRET + r"\s*[=:]\s*\"?[A-Za-z0-9_\-]{8,}\"?"),
    ("access_key", r"\bAKIA[A-Z0-9]{16}\b"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("phone", r"\+\d{1,3} ?\(\d{2,4}\) ?\d{3}-\d{4}|\(\d{3}\) ?\d{3}-\d{4}|\+\d{1,3}(?:[ .\-]\d{2,4}){2,4}\b|\+\d{8,15}\b|\b\d{3}-\d{3}-\d{4}\b|\b\d{3}\.\d{3}\.\d{4}\b|\b0\d{2,4} \d{3,4} \d{3,4}\b"),
    ("card", r"\b\d{4}(?:[ \-]?)\d{4}(?:[ \-]?)\d{4}(?:[ \-]?)\d{4}\b|\b3[47]\d\d[ \-]?\d{6}[ \-]?\d{5}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("ip", r"\b(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}\b(?!\.\d)"),
    ("ipv6", r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![\w:])"),
    ("address", rf"\b\d{{1,5}} (?:[{_UP}][^\W\d_]+ ){{1,3}}(?:{_ROAD})\b|\b[{_UP}][^\W\d_]*(?:straße|strasse|gasse|platz|weg|allee) \d{{1,4}}\b"),
]
KINDS = [*(k for k, _ in PATTERNS), "name"]
FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
SECRET_HINTS = ["password", "passwd", "secret", "token", "api_key"]
_digit = re.compile("[0-9@]").search


class Lexicon:
    """Given names: their group, their place in it, and the names of each group."""

    def __init__(self, names: dict[tuple[str, str], list[str]]):
        self.groups = {k: sorted(set(v)) for k, v in names.items()}
        self.of = {}
        for k, group in sorted(self.groups.items()):
            for i, n in enumerate(group):
                self.of.setdefault(n, (k, i))

        self.groups["initial"] = [chr(65 + i) for i in range(26)]
        self.cycles: dict = {}

    def swap(self, key: bytes, group, at: int) -> str:
        """The next name after this one in the group's keyed cycle: another for each, and never itself."""
        if (key, group) not in self.cycles:
            names = self.groups[group]
            order = sorted(names, key=lambda n: _prf(key, "given", group, n))
            self.cycles[key, group] = dict(zip(order, [*order[1:], order[0]], strict=True))
        return self.cycles[key, group][self.groups[group][at]]

    def find(self, word: str):
        return self.of.get(word) or (self.of.get(word.capitalize()) if word.isupper() else None)


LEXICON = Lexicon(NAMES)


def entities(text: str, lexicon: Lexicon = LEXICON) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, type, normalised entity) of each find, left to right."""
    found = []
    low = None
    if not _digit(text) and "AKIA" not in text:
        low = text.lower()
    if low is None or any(h in low for h in SECRET_HINTS):
        for m in FIND.finditer(text):
            kind = m.lastgroup
            if (kind == "iban" and not _iban(m.group())) or (kind == "ipv6" and not _ipv6(m.group())):
                continue
            found.append((m.start(), m.end(), kind, normal(kind, m.group())))
    names = list(_names(text, lexicon))
    if not names or not found:
        yield from names or found
        return
    end = 0
    for x in sorted([*found, *names], key=lambda x: (x[0], x[2] == "name")):
        if x[0] >= end:
            yield x
            end = x[1]


def _names(text: str, lexicon: Lexicon) -> Iterator[tuple[int, int, str, str]]:
    """A title with up to two words, or given names of the lexicon and one more word; initials and particles between."""
    for run in _RUN.finditer(text):
        words = [(m.start() + run.start(), m.end() + run.start(), m.group()) for m in _TOKEN.finditer(run.group())]
        small = [w in PARTICLES or (len(w) == 2 and w[1] == ".") for _, _, w in words]
        i = 0
        while i < len(words):
            titled = words[i][2].rstrip(".") in _titles
            if small[i] or not (titled or lexicon.find(words[i][2])):
                i += 1
                continue
            # given names, then one more word; after a title two words where none is a given name
            j, last, left = i + titled, i, 2
            while j < len(words) and left:
                if not small[j]:
                    given = lexicon.find(words[j][2]) and any(not x for x in small[j + 1 :])
                    left = 1 if given else left - 1
                    last = j
                j += 1
            if last > i:
                yield words[i][0], words[last][1], "name", " ".join(w for _, _, w in words[i + titled : last + 1])
                i = last
            i += 1


def _iban(found: str) -> bool:
    x = found.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _ipv6(found: str) -> bool:
    try:
        return ipaddress.IPv6Address(found).is_private in (True, False) and found.count(":") > 1
    except ValueError:
        return False


def normal(kind: str, found: str) -> str:
    """What makes mentions the same entity."""
    if kind == "email":
        return found.lower()
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", found)
    if kind == "iban":
        return found.replace(" ", "")
    if kind == "ipv6":
        return ipaddress.IPv6Address(found).exploded
    if kind == "secret":
        return re.split(r"[=:]", found, maxsplit=1)[1].strip().strip('"')
    if kind == "address":
        return " ".join(found.split()).lower()
    return found


def name_words(entity: str, lexicon: Lexicon) -> list[tuple[str, str]]:
    """The words of a name in order, as (role, word): given, initial, particle or family."""
    words = entity.split(" ")
    out = []
    for k, w in enumerate(words):
        if w in PARTICLES:
            out.append(("particle", w))
        elif len(w) == 2 and w[1] == ".":
            out.append(("initial", w[0]))
        elif k + 1 < len(words) and lexicon.find(w):
            out.append(("given", w))
        else:
            out.append(("family", w))
    return out


def family_units(word: str) -> list[tuple[str, bool, bool]]:
    """(normalised word, feminine, letters that stay) of the pieces of a family name, split at hyphens and apostrophes."""
    out = []
    for piece in re.split(r"(['’\-])", word):
        if len(piece) < 2:
            out.append((piece, False, True))
            continue
        w = piece.capitalize() if piece.isupper() or piece.islower() else piece
        end = next(((f, m) for f, m in ENDINGS if w.endswith(f) and len(w) > len(f) + 1), None)
        out.append((w[: -len(end[0])] + end[1] if end else w, bool(end), False))
    return out


def units(kind: str, entity: str, lexicon: Lexicon = LEXICON) -> list[tuple[str, str]]:
    """What of an entity gets a surrogate under the collision check."""
    if kind != "name":
        return [(kind, entity)]
    return [("name", u) for role, w in name_words(entity, lexicon) if role == "family" for u, _, stays in family_units(w) if not stays]


# ------------------------------------------------------------------ keyed numbers
def _prf(key: bytes, *what) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, what)).encode(), hashlib.sha256).digest(), "big")


def permute(key: bytes, label: str, x: int, size: int) -> int:
    """A keyed permutation of 0..size-1: four Feistel rounds on a square that covers the range, walked until inside."""
    side = 1
    while side * side < size:
        side += 1 if side < 64 else side // 16
    while True:
        a, b = divmod(x, side)
        for r in range(4):
            a, b = b, (a + _prf(key, label, r, b)) % side
        x = a * side + b
        if x < size:
            return x


def _digits(key: bytes, label: str, digits: str) -> str:
    return str(permute(key, f"{label}{len(digits)}", int(digits), 10 ** len(digits))).zfill(len(digits)) if digits else digits


def luhn(digits: str) -> str:
    """The check digit that follows these digits."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """The normalised surrogate of a normalised entity."""
    label = f"{kind}/{attempt}"
    if kind == "email":
        h = _prf(key, label, entity)
        return f"user-{h % 36**14:x}@mail{h >> 128 & 63}.example.org"
    if kind == "card":
        body = _digits(key, label, entity[:-1])
        return body + str((int(luhn(body)) + int(entity[-1]) - int(luhn(entity[:-1]))) % 10)
    if kind in ("phone", "ssn") and len(entity) > 7:
        return entity[: max(0, len(entity) - 10)] + _digits(key, label, entity[-10:]) if kind == "phone" else _digits(key, label, entity)
    if kind in ("ssn", "phone"):
        return _digits(key, label, entity)
    if kind == "iban":
        return _like_iban(key, label, entity)
    if kind == "ipv6":
        # the prefix of documentation, and 96 bits
        return ipaddress.IPv6Address(0x20010DB8 << 96 | _prf(key, label, entity) >> 160).exploded
    if kind == "address":
        return re.sub(r"\d+|[^\W\d_]+", lambda m: _digits(key, label, m.group()) if m.group().isdigit() else _road(key, label, m.group(), attempt), entity)
    if kind == "ip":
        # the upper half of 10.0.0.0/8 and 240.0.0.0/4 never name a public host; numbers outside them are permuted into all of 32 bits
        n = int.from_bytes(bytes(map(int, entity.split("."))), "big")
        return ".".join(map(str, permute(key, label, n, 1 << 32).to_bytes(4, "big")))
    if kind == "access_key":
        return "AKIA" + _letters(_prf(key, label, entity), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)
    if kind == "secret":
        alphabet = "0123456789abcdef" if re.fullmatch("[0-9A-Fa-f]+", entity) else "abcdefghijklmnopqrstuvwxyz0123456789"
        alphabet = alphabet.upper() if entity.isupper() else alphabet
        return _letters(_prf(key, label, entity) | _prf(key, label, entity, 2) << 256, alphabet, len(entity))
    return _surname(key, label, entity, script(entity), attempt)


def _road(key: bytes, label: str, word: str, attempt: int) -> str:
    if re.fullmatch(_ROAD, word.capitalize()):
        return word
    end = next((x for x in ("straße", "strasse", "gasse", "platz", "weg", "allee") if word.endswith(x)), "")
    return _surname(key, label, word[: len(word) - len(end)], script(word), attempt).lower() + end


def _like_iban(key: bytes, label: str, entity: str) -> str:
    """Digits and letters of the account under permutations of their own, with valid check digits."""
    body = entity[4:]
    digits, letters = re.sub("[A-Z]", "", body), re.sub("[0-9]", "", body)
    new = iter(_digits(key, label, digits)) if digits else iter("")
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 65
    n, out = permute(key, f"{label}/letters{len(letters)}", n, 26 ** len(letters)) if letters else 0, []
    for _ in letters:
        n, k = divmod(n, 26)
        out.append(chr(65 + k))
    own = iter(reversed(out))
    body = "".join(next(new) if c.isdigit() else next(own) for c in body)
    rest = int("".join(str(int(c, 36)) for c in body + entity[:2] + "00")) % 97
    return f"{entity[:2]}{98 - rest:02d}{body}"


def _letters(h: int, alphabet: str, n: int) -> str:
    out = []
    for _ in range(n):
        h, k = divmod(h, len(alphabet))
        out.append(alphabet[k])
        h = h or _prf(b"more", "".join(out))
    return "".join(out)


def _surname(key: bytes, label: str, name: str, script: str, attempt: int) -> str:
    h = _prf(key, label, "family", name)
    return "".join(SYLLABLES[script][h >> 4 * i & 15] for i in range(4 + attempt)).capitalize()


def script(word: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", word) else "greek" if re.search("[Ͱ-Ͽἀ-῿]", word) else "latin"


def rendered(kind: str, found: str, new: str) -> str:
    """A normalised surrogate in the form of the mention it replaces."""
    if kind in ("phone", "card", "ssn"):
        it = iter(new)
        return re.sub(r"\d", lambda _: next(it), found)
    if kind == "iban":
        it = iter(new)
        return re.sub("[A-Z0-9]", lambda _: next(it), found)
    if kind == "secret":
        old = normal(kind, found)
        at = found.rindex(old)
        return found[:at] + new + found[at + len(old) :]
    if kind == "address":
        it = iter(new.split(" "))
        return re.sub(r"\S+", lambda m: (lambda w: w.capitalize() if m.group()[:1].isupper() else w)(next(it)), found)
    if kind == "email" and found.isupper():
        return new.upper()
    if kind == "ipv6":
        x = ipaddress.IPv6Address(new)
        x = x.compressed if "::" in found or len(found) < 39 else x.exploded
        return x.upper() if found != found.lower() else x
    return new


def rendered_name(key: bytes, found: str, lexicon: Lexicon, family) -> str:
    """A name with each word replaced in its own form; family(word) gives the surrogate of a family word."""
    tokens = found.replace("\u00a0", " ").split(" ")
    n = 1 if tokens[0].rstrip(".") in _titles and len(tokens) > 1 else 0
    out = tokens[:n]
    for (role, w), token in zip(name_words(" ".join(tokens[n:]), lexicon), tokens[n:], strict=True):
        if role == "given":
            group, at = lexicon.find(w)
            new = lexicon.swap(key, group, at)
            out.append(new.upper() if w.isupper() and len(w) > 1 else new)
        elif role == "initial":
            out.append((lexicon.swap(key, "initial", ord(w) - 65) if "A" <= w <= "Z" else w) + ".")
        elif role == "family":
            parts = []
            for u, feminine, stays in family_units(w):
                new = u if stays else family(u)
                if feminine:
                    f, m = next((f, m) for f, m in ENDINGS if u.endswith(m) and (m or script(u) == "latin"))
                    new += f
                elif not stays:
                    new += next((m for f, m in ENDINGS if m and u.endswith(m)), "")
                parts.append(new.upper() if w.isupper() else new)
            out.append("".join(parts))
        else:
            out.append(token)
    return " ".join(out)


# ------------------------------------------------------------------ corpus
def _gather(shared):
    def run(batches):
        for b in batches:
            rows = set()
            for i in range(0, b.num_rows, 256):
                rows |= {u for t in b.column(0).slice(i, 256).to_pylist() if t for _, _, k, e in entities(t, shared.value) for u in units(k, e, shared.value)}
            rows = sorted(rows)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([e for _, e in rows], pa.string())], ["kind", "entity"])

    return run


def _propose(key: bytes):
    def run(batches):
        for b in batches:
            k, e, a = (b.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([surrogate(key, *x) for x in zip(k, e, a, strict=True)], pa.string())], ["kind", "entity", "attempt", "new"])

    return run


def assign(docs: DataFrame, key: bytes = KEY, lexicon: Lexicon = LEXICON) -> DataFrame:
    """(kind, entity, attempt, new): distinct surrogates, none of which is an entity of the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    found = arrow_map(docs.select("text"), _gather(shared), "kind string, entity string").distinct()
    schema = "kind string, entity string, attempt int, new string"
    names = cut(arrow_map(found.withColumn("attempt", F.lit(0)), _propose(key), schema), "pii-names")
    for _ in range(MAX_ATTEMPTS):
        first = names.groupBy("kind", "new").agg(F.min("entity").alias("first"), F.count("*").alias("n")).filter("n > 1").select("kind", "new", "first")
        clash = names.join(first, ["kind", "new"]).filter("entity <> first").select("kind", "entity")
        real = names.join(names.select("kind", F.col("entity").alias("new")), ["kind", "new"], "left_semi").select("kind", "entity")
        again = cut(clash.unionByName(real).distinct().withColumn("hit", F.lit(1)), "pii-again")
        if not again.limit(1).count():
            return names
        moved = arrow_map(names.join(again, ["kind", "entity"]).select("kind", "entity", (F.col("attempt") + 1).alias("attempt")), _propose(key), schema)
        names = cut(names.join(again, ["kind", "entity"], "left_anti").select("kind", "entity", "attempt", "new").unionByName(moved), "pii-names")
    raise RuntimeError(f"surrogates still collide after {MAX_ATTEMPTS} attempts")


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], int], made: dict[tuple[str, str], str], lexicon: Lexicon = LEXICON) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with surrogates, and (type, start, end) of each in the new text."""
    out, spans, last, size = [], [], 0, 0

    def one(kind: str, entity: str) -> str:
        new = made.get((kind, entity))
        if new is None:
            new = made[kind, entity] = surrogate(key, kind, entity, attempts.get((kind, entity), 0))
        return new

    for a, b, kind, entity in entities(text, lexicon):
        new = rendered_name(key, text[a:b], lexicon, lambda u: one("name", u)) if kind == "name" else rendered(kind, text[a:b], one(kind, entity))
        out += [text[last:a], new]
        size += a - last
        spans.append((kind, size, size + len(new)))
        size, last = size + len(new), b
    return ("".join([*out, text[last:]]) if out else text), spans


SPANS = "array<struct<kind:string,start:int,end:int>>"
LATE = "array<struct<kind:string,entity:string,attempt:int>>"


def rewrite(docs: DataFrame, key: bytes = KEY, *, spans: bool = False, keep: list[str] | None = None, block: int = BLOCK, names: dict | None = None) -> DataFrame:
    """The documents with surrogates in `text`; with spans, pii_spans of the new text. names: a lexicon like NAMES."""
    keep = keep or docs.columns
    spark, lexicon = docs.sparkSession, Lexicon(names) if names else LEXICON
    late = cut(assign(docs, key, lexicon).filter("attempt > 0").select("kind", "entity", "attempt"), "pii-late")
    n = max(1, -(-late.count() // block))
    df, at = docs.select(*[F.col(f"`{c}`") for c in keep]), keep.index("text")
    for i in range(n):
        some = {(r[0], r[1]): r[2] for r in late.filter(F.pmod(F.xxhash64("kind", "entity"), F.lit(n)) == i).toLocalIterator()}
        shared = spark.sparkContext.broadcast((some, lexicon))
        if i + 1 < n:
            if i == 0:
                df = df.select("*", F.array().cast(LATE).alias("__pii_late"))
            df = arrow_map(df, _mark(shared, at), df.schema)
    return _apply(df, key, shared, spans, [docs.schema[c] for c in keep], at)


def _mark(shared, at: int):
    """Adds to each text's list the exceptions of this block that it holds."""

    def run(batches):
        attempts, lexicon = shared.value
        for b in batches:
            old = b.column(b.num_columns - 1).to_pylist()
            for late, text in zip(old, b.column(at).to_pylist(), strict=True):
                late += [{"kind": k, "entity": e, "attempt": attempts[k, e]} for k, e in sorted({u for _, _, k, e in entities(text or "", lexicon) for u in units(k, e, lexicon)}) if (k, e) in attempts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(old, b.schema.field(b.num_columns - 1).type)], b.schema.names)

    return run


def _apply(df: DataFrame, key: bytes, shared, spans: bool, fields: list, at: int) -> DataFrame:
    names = [f.name for f in fields]
    marked = len(df.columns) > len(names)

    def run(batches):
        (attempts, lexicon), made = shared.value, {}
        for b in batches:
            new, marks = [], []
            col = b.column(at)
            own = b.column(len(names)).to_pylist() if marked else None
            for i in range(0, b.num_rows, 256):
                for k, t in enumerate(col.slice(i, 256).to_pylist(), i):
                    if own and own[k]:
                        got = replace(t, key, attempts | {(x["kind"], x["entity"]): x["attempt"] for x in own[k]}, {}, lexicon)
                    else:
                        got = (t, []) if t is None else replace(t, key, attempts, made, lexicon)
                    new.append(got[0])
                    marks.append([{"kind": x, "start": s, "end": e} for x, s, e in got[1]])
            if len(made) > 100_000:
                made.clear()
            cols = [*b.columns[: len(names)]]
            cols[at] = pa.array(new, pa.string())
            if spans:
                cols.append(pa.array(marks, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(cols, [*names, *["pii_spans"] * spans])

    schema = T.StructType([*fields, *([T.StructField("pii_spans", T._parse_datatype_string(SPANS))] if spans else [])])
    return arrow_map(df, run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the rewritten text, and how many surrogates of each type it holds."""
    out = rewrite(docs, spans=True, keep=["doc_id", "text"])
    def count(kind: str):
        return F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return out.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_entities"), *counts)
