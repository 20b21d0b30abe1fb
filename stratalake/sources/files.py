"""Listing and reading of layer files: local paths, and any scheme that Hadoop's file systems know."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession


def plain(path: str) -> str:
    """A file: URI as the local path it names; any other path as it is."""
    return re.sub(r"^file:(//(?=/))?", "", path) if path.startswith("file:/") else path


def remote(path: str) -> bool:
    return re.match(r"[A-Za-z][A-Za-z0-9+.\-]+://", path) is not None and not path.startswith("file:")


def _hadoop(path: str):
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError(f"{path} needs a running Spark session")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_dir(path: str) -> bool:
    if not remote(path):
        return os.path.isdir(plain(path))
    fs, p = _hadoop(path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def exists(path: str) -> bool:
    if not remote(path):
        return os.path.exists(plain(path))
    fs, p = _hadoop(path)
    return fs.exists(p)


def listing(folder: str) -> list[tuple[str, bool, float, int]]:
    """(name, is a directory, time of change, size) of what a folder holds, by name."""
    if not remote(folder):
        folder = plain(folder)
        with os.scandir(folder) as it:
            found = [(e.name, e.is_dir(), e.stat().st_mtime, e.stat().st_size) for e in it]
    else:
        fs, p = _hadoop(folder)
        found = [(s.getPath().getName(), s.isDirectory(), float(s.getModificationTime()), s.getLen()) for s in fs.listStatus(p)]
    return sorted(found)


def walk(path: str) -> Iterator[tuple[str, float, int]]:
    """(path, time of change, size) of the files below a folder, or of a file itself; hidden names are left out."""
    if is_dir(path):
        for name, folder, at, size in listing(path):
            if name.startswith("."):
                continue
            if folder:
                yield from walk(f"{path}/{name}")
            else:
                yield f"{path}/{name}", at, size
    elif not remote(path):
        s = os.stat(plain(path))
        yield path, s.st_mtime, s.st_size
    else:
        fs, p = _hadoop(path)
        s = fs.getFileStatus(p)
        yield path, float(s.getModificationTime()), s.getLen()


def read_text(path: str) -> str:
    if not remote(path):
        return Path(plain(path)).read_text(encoding="utf-8")
    fs, p = _hadoop(path)
    stream = fs.open(p)
    try:
        return SparkSession.getActiveSession()._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def copy(source: str, target: str) -> None:
    """A file of any scheme under another name, through Hadoop."""
    spark = SparkSession.getActiveSession()
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    (a, p), q = _hadoop(source), jvm.org.apache.hadoop.fs.Path(target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, q.getFileSystem(conf), q, False, conf)
