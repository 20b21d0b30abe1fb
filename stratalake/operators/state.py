"""Versioned scratch tables: each write makes a new directory, so nothing is overwritten while it is read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_roots: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir), or a local one where that is unset."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="stratalake-")
        _roots[app] = f"{base.rstrip('/')}/lake-{uuid.uuid4().hex[:12]}"
        atexit.register(_clean, spark, _roots[app])
    return _roots[app]


def _clean(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def save(df: DataFrame, name: str) -> str:
    path = f"{root(df.sparkSession)}/{name.replace('#', 'temp-')}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return path


def counted(df: DataFrame, name: str) -> tuple[str, int]:
    """Saves a table and gives the number of its rows, in one job."""
    seen = Observation()
    path = save(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return path, int(seen.get["n"])


def load(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
