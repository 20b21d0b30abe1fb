"""The SQL door's spellings that Spark SQL has other words for, rewritten token by token."""

from __future__ import annotations

import re

SQL_FUNCTIONS = ["CREATE OR REPLACE TEMPORARY FUNCTION regexp_full_match(s STRING, p STRING) RETURNS BOOLEAN RETURN s RLIKE concat('^(?:', p, ')$')"]


def literals(sql: str) -> str:
    """Text literals with a quote inside, in a form that stays right while backslashes stand for themselves."""
    if "''" not in sql:
        return sql

    def one(m: re.Match) -> str:
        if not m[1] or "''" not in m[1][1:-1]:
            return m[0]
        value = m[1][1:-1].replace("''", "'")
        if '"' not in value:
            return f'"{value}"'
        return "concat(" + ", ".join(["\"'\"" if p == "'" else f"'{p}'" for p in re.split("(')", value) if p]) + ")"

    return re.sub(r"""\w'(?:[^']|'')*'|('(?:[^']|'')*')|"[^"]*"|`[^`]*`|--[^\n]*|/\*.*?\*/""", one, sql, flags=re.S)


def _mask(text: str) -> str:
    """The text with what stands in quotes and comments blanked, at the same places."""
    return re.sub(r"""'(?:[^']|'')*'|"[^"]*"|`[^`]*`|--[^\n]*|/\*.*?\*/""", lambda m: " " * len(m.group()), text, flags=re.S)


def rewrite(text: str) -> tuple[str, str | None]:
    """(the statement in Spark's words, the columns of RETURNING if it is a write that has them)."""
    returning = None
    if re.match(r"(?i)\s*(insert|update|delete)\b", text):
        found = [m for m in re.finditer(r"(?i)\bRETURNING\b", _mask(text))]
        if found:
            returning = text[found[-1].end() :].rstrip().rstrip(";")
            text = text[: found[-1].start()]
        return text, returning
    for pattern, change in CHANGES:
        at = 0
        while m := pattern.search(_mask(text), at):
            new = change(text, m)
            if new is None:
                at = m.end()
                continue
            text, at = new
    return text, returning


def _materialized(text: str, m: re.Match) -> tuple[str, int]:
    return text[: m.start()] + "AS (" + text[m.end() :], m.start() + 4


def _end(text: str, at: int, pair: str) -> int:
    """Where the bracket that is open before `at` closes."""
    depth, masked = 1, _mask(text)
    for k in range(at, len(text)):
        depth += (masked[k] == pair[0]) - (masked[k] == pair[1])
        if not depth:
            return k
    raise ValueError(f"{pair[0]} is not closed")


def _parts(text: str) -> list[str]:
    """Split at commas outside brackets and quotes."""
    out, depth, last, masked = [], 0, 0, _mask(text)
    for k, c in enumerate(masked):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            out.append(text[last:k])
            last = k + 1
    return [*out, text[last:]] if text.strip() else []


def _struct(text: str, m: re.Match) -> tuple[str, int]:
    end = _end(text, m.end(), "{}")
    fields = []
    for p in _parts(text[m.end() : end]):
        k = _mask(p).find(":")
        name = p[:k].strip().strip("'\"`")
        fields += [f"'{name}'", p[k + 1 :].strip()]
    return f"{text[: m.start()]}named_struct({', '.join(fields)}){text[end + 1 :]}", m.start() + 13


def _array(text: str, m: re.Match) -> tuple[str, int] | None:
    before = text[: m.start()].rstrip()
    # after a name, a bracket or a string it is a subscript
    if before and (before[-1].isalnum() or before[-1] in "_)]'\"`") and not re.search(r"(?i)\b(select|in|when|then|else|and|or|not|by|on|where|having|values|return|distinct|all)$", before):
        return None
    end = _end(text, m.end(), "[]")
    return f"{text[: m.start()]}array({text[m.end() : end]}){text[end + 1 :]}", m.start() + 6


def _list(text: str, m: re.Match) -> tuple[str, int]:
    """list(x ORDER BY y [DESC], ..): the values in that order, as an array without its sort keys."""
    end = _end(text, m.end(), "()")
    body = text[m.end() : end]
    by = re.search(r"(?i)\bORDER\s+BY\b", _mask(body))
    if not by:
        return f"{text[: m.start()]}collect_list({body}){text[end + 1 :]}", m.start() + 13
    value, keys = body[: by.start()].strip(), _parts(body[by.end() :])
    split = [re.fullmatch(r"(?is)(.*?)(\s+(?:ASC|DESC))?", k.strip()).groups() for k in keys]
    items = ", ".join([f"{k} AS k{i}" for i, (k, _) in enumerate(split)] + [f"{value} AS v"])
    tests = " ".join(f"WHEN l.k{i} IS NULL AND r.k{i} IS NOT NULL THEN 1 WHEN r.k{i} IS NULL AND l.k{i} IS NOT NULL THEN -1 WHEN l.k{i} < r.k{i} THEN {'1' if d and d.strip().upper() == 'DESC' else '-1'} WHEN l.k{i} > r.k{i} THEN {'-1' if d and d.strip().upper() == 'DESC' else '1'}" for i, (_, d) in enumerate(split))
    return f"{text[: m.start()]}transform(array_sort(collect_list(struct({items})), (l, r) -> CASE {tests} ELSE 0 END), x -> x.v){text[end + 1 :]}", m.start() + 10


def _replace(text: str, m: re.Match) -> tuple[str, int]:
    """SELECT * REPLACE (e AS c, ..): the other columns as they are, then the new ones."""
    end = _end(text, m.end(), "()")
    items = [re.fullmatch(r"(?is)(.*)\s+AS\s+(\S+)\s*", p).groups() for p in _parts(text[m.end() : end])]
    return f"{text[: m.start()]}* EXCEPT ({', '.join(c for _, c in items)}), {', '.join(f'{e.strip()} AS {c}' for e, c in items)}{text[end + 1 :]}", m.start() + 1


CHANGES = [
    (re.compile(r"(?i)\bAS\s+(?:NOT\s+)?MATERIALIZED\s*\("), _materialized),
    (re.compile(r"(?i)\*\s*REPLACE\s*\("), _replace),
    (re.compile(r"\{"), _struct),
    (re.compile(r"\["), _array),
    (re.compile(r"(?i)\blist\s*\("), _list),
]
