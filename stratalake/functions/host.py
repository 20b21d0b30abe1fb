"""Password hashes of the dialect, evaluated in Python (batched)."""

from __future__ import annotations

import hashlib
import os

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf


def encrypt(password: str | None, salt: bytes | None = None) -> bytes | None:
    """Version 0x0200, a 4-byte salt, and SHA-512 over the UTF-16 password and the salt."""
    if password is None:
        return None
    salt = os.urandom(4) if salt is None else salt
    return b"\x02\x00" + salt + hashlib.sha512(password.encode("utf-16-le") + salt).digest()


def matches(password: str | None, stored: bytes | None) -> int | None:
    """1 where the password gave the stored hash; version 0x0100 is salted SHA-1."""
    if password is None or stored is None:
        return None
    stored = bytes(stored)
    kind = {b"\x02\x00": hashlib.sha512, b"\x01\x00": hashlib.sha1}.get(stored[:2])
    if kind is None or len(stored) < 6:
        return 0
    return int(kind(password.encode("utf-16-le") + stored[2:6]).digest() == stored[6 : 6 + kind().digest_size])


def register(spark: SparkSession) -> None:
    @pandas_udf("binary")
    def pwdencrypt(p: pd.Series) -> pd.Series:
        return p.map(encrypt)

    @pandas_udf("int")
    def pwdcompare(p: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([matches(a, b) for a, b in zip(p, h, strict=True)], dtype="Int32")

    spark.udf.register("pwdencrypt", pwdencrypt.asNondeterministic())
    spark.udf.register("pwdcompare", pwdcompare)
