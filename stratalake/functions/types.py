"""T-SQL type names and the Spark types they stand for."""

from __future__ import annotations

from stratalake.plans.tsql.lexer import TSqlError

# fixed values: the dialect's type names and their meaning
SIMPLE = {
    "bit": "BOOLEAN", "tinyint": "SMALLINT", "smallint": "SMALLINT", "int": "INT", "integer": "INT", "bigint": "BIGINT",
    "real": "FLOAT", "float": "DOUBLE", "double": "DOUBLE", "money": "DECIMAL(19,4)", "smallmoney": "DECIMAL(10,4)",
    "date": "DATE", "time": "TIME(6)", "datetime": "TIMESTAMP_NTZ", "datetime2": "TIMESTAMP_NTZ", "smalldatetime": "TIMESTAMP_NTZ",
    "datetimeoffset": "TIMESTAMP", "uniqueidentifier": "STRING", "binary": "BINARY", "varbinary": "BINARY", "image": "BINARY",
    "rowversion": "BINARY", "timestamp": "BINARY", "char": "STRING", "varchar": "STRING", "nchar": "STRING", "nvarchar": "STRING",
    "text": "STRING", "ntext": "STRING", "xml": "STRING", "sql_variant": "STRING", "sysname": "STRING",
}


def spark_type(name: str, args: list[str] = ()) -> str:
    """The Spark SQL type; lengths of text and binary types are dropped."""
    name = name.lower()
    if name in ("decimal", "numeric"):
        p, s = (int(args[0]) if args else 18), (int(args[1]) if len(args) > 1 else 0)
        if not 1 <= p <= 38 or s > p:
            raise TSqlError(f"invalid precision {p} or scale {s}", 1007)
        return f"DECIMAL({p},{s})"
    if name in SIMPLE:
        return SIMPLE[name]
    return name.upper() + (f"({','.join(args)})" if args else "")


def is_integral(t: str) -> bool:
    return t in ("tinyint", "smallint", "int", "bigint")


def is_decimal(t: str) -> bool:
    return t.startswith("decimal")


def is_number(t: str) -> bool:
    return is_integral(t) or is_decimal(t) or t in ("float", "double")


def cast_to(sql: str, target: str, source: str | None, attempt: bool = False) -> str:
    """A cast with the dialect's rounding: decimals to integers half up, doubles half even; text to a uniqueidentifier stays text."""
    word = "TRY_CAST" if attempt else "CAST"
    if target in ("SMALLINT", "INT", "BIGINT") and source:
        if is_decimal(source):
            sql = f"round({sql})"
        elif source in ("float", "double"):
            sql = f"rint({sql})"
    if target == "BOOLEAN" and source == "string":
        return f"{word}({sql} AS BOOLEAN)"
    return f"{word}({sql} AS {target})"
