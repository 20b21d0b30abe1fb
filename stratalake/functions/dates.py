"""Date parts, date arithmetic and CONVERT styles as Spark SQL."""

from __future__ import annotations

from stratalake.plans.tsql.lexer import TSqlError

# fixed values: the dialect's date part names
PARTS = {
    "year": "year", "yy": "year", "yyyy": "year", "quarter": "quarter", "qq": "quarter", "q": "quarter", "month": "month", "mm": "month", "m": "month",
    "dayofyear": "dayofyear", "dy": "dayofyear", "y": "dayofyear", "day": "day", "dd": "day", "d": "day", "week": "week", "wk": "week", "ww": "week",
    "weekday": "weekday", "dw": "weekday", "w": "weekday", "hour": "hour", "hh": "hour", "minute": "minute", "mi": "minute", "n": "minute",
    "second": "second", "ss": "second", "s": "second", "millisecond": "millisecond", "ms": "millisecond", "microsecond": "microsecond", "mcs": "microsecond",
    "nanosecond": "nanosecond", "ns": "nanosecond", "iso_week": "week",
}

# fixed values: the dialect's CONVERT style numbers and their formats
STYLES = {
    1: "MM/dd/yy", 2: "yy.MM.dd", 3: "dd/MM/yy", 4: "dd.MM.yy", 5: "dd-MM-yy", 6: "dd MMM yy", 7: "MMM dd, yy", 8: "HH:mm:ss",
    10: "MM-dd-yy", 11: "yy/MM/dd", 12: "yyMMdd", 14: "HH:mm:ss:SSS", 20: "yyyy-MM-dd HH:mm:ss", 21: "yyyy-MM-dd HH:mm:ss.SSS", 23: "yyyy-MM-dd",
    24: "HH:mm:ss", 25: "yyyy-MM-dd HH:mm:ss.SSS", 101: "MM/dd/yyyy", 102: "yyyy.MM.dd", 103: "dd/MM/yyyy", 104: "dd.MM.yyyy", 105: "dd-MM-yyyy",
    106: "dd MMM yyyy", 107: "MMM dd, yyyy", 108: "HH:mm:ss", 110: "MM-dd-yyyy", 111: "yyyy/MM/dd", 112: "yyyyMMdd", 113: "dd MMM yyyy HH:mm:ss:SSS",
    114: "HH:mm:ss:SSS", 120: "yyyy-MM-dd HH:mm:ss", 121: "yyyy-MM-dd HH:mm:ss.SSS", 126: "yyyy-MM-dd'T'HH:mm:ss.SSS", 127: "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
}


def part(name: str) -> str:
    if name.lower() not in PARTS:
        raise TSqlError(f"unknown date part {name}", 155)
    return PARTS[name.lower()]


def datepart(name: str, d: str) -> str:
    p, t = part(name), f"CAST({d} AS TIMESTAMP_NTZ)"
    micros = f"CAST(date_part('SECONDS', {t}) * 1000000 AS BIGINT)"
    sql = {
        "dayofyear": f"dayofyear({t})",
        "week": f"weekofyear({t})",
        "weekday": f"(dayofweek({t}) - 1)",
        "second": f"second({t})",
        "millisecond": f"({micros} div 1000)",
        "microsecond": micros,
        "nanosecond": f"({micros} * 1000)",
    }.get(p, f"{p}({t})")
    return f"CAST({sql} AS BIGINT)"


def datediff(name: str, a: str, b: str) -> str:
    """Boundaries crossed between a and b; weeks are whole sevens of days."""
    p = part(name)
    a, b = f"CAST({a} AS TIMESTAMP_NTZ)", f"CAST({b} AS TIMESTAMP_NTZ)"
    if p == "year":
        return f"CAST(year({b}) - year({a}) AS BIGINT)"
    if p == "quarter":
        return f"CAST((year({b}) - year({a})) * 4 + quarter({b}) - quarter({a}) AS BIGINT)"
    if p == "month":
        return f"CAST((year({b}) - year({a})) * 12 + month({b}) - month({a}) AS BIGINT)"
    days = f"datediff(CAST({b} AS DATE), CAST({a} AS DATE))"
    if p in ("day", "dayofyear", "weekday"):
        return f"CAST({days} AS BIGINT)"
    if p == "week":
        return f"({days} div 7)"
    micros = f"(timestampdiff(MICROSECOND, date_trunc('{{0}}', {a}), date_trunc('{{0}}', {b})) div {{1}})"
    unit = {"hour": ("HOUR", 3_600_000_000), "minute": ("MINUTE", 60_000_000), "second": ("SECOND", 1_000_000), "millisecond": ("MILLISECOND", 1000), "microsecond": ("MICROSECOND", 1), "nanosecond": ("MICROSECOND", 1)}[p]
    sql = micros.format(*unit)
    return f"({sql} * 1000)" if p == "nanosecond" else sql


def dateadd(name: str, n: str, d: str) -> str:
    p = part(name)
    d, n = f"CAST({d} AS TIMESTAMP_NTZ)", f"CAST({n} AS INT)"
    months = {"year": f"{n} * 12", "quarter": f"{n} * 3", "month": n}.get(p)
    if months:
        return f"({d} + make_ym_interval(0, {months}))"
    scale = {"week": 604800, "day": 86400, "dayofyear": 86400, "weekday": 86400, "hour": 3600, "minute": 60, "second": 1}.get(p)
    if scale:
        return f"({d} + make_dt_interval(CAST(CAST({n} AS BIGINT) * {scale} div 86400 AS INT), 0, 0, CAST(CAST({n} AS BIGINT) * {scale} % 86400 AS DECIMAL(18,6))))"
    over = {"millisecond": 1000, "microsecond": 1_000_000}.get(p)
    if not over:
        raise TSqlError(f"date part {name} cannot be added", 9810)
    return f"({d} + make_dt_interval(0, 0, 0, CAST({n} AS DECIMAL(18,6)) / {over}))"


def convert(target: str, sql: str, style: int, source: str | None) -> str:
    if style not in STYLES:
        raise TSqlError(f"{style} is not a valid style number", 281)
    pattern = STYLES[style].replace("'", "''")
    if target == "STRING":
        if source in ("date", "timestamp", "timestamp_ntz"):
            return f"date_format({sql}, '{pattern}')"
        raise TSqlError("a style applies to dates only", 281)
    if target in ("DATE", "TIMESTAMP_NTZ", "TIMESTAMP"):
        if source in ("date", "timestamp", "timestamp_ntz"):
            return f"CAST({sql} AS {target})"
        return f"CAST(to_timestamp_ntz({sql}, '{pattern}') AS {target})"
    raise TSqlError("a style applies to dates and text only", 281)
