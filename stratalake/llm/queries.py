"""The registered queries of the ten operators and of the pipeline, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalake.llm import decontam, license, maxent, neardup, packing, pii, quality, tiff, urlfilter, warc
from stratalake.llm.common import table


def op1_decontamination(spark, sf_dir):
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_surrogates(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op3_neardup(spark, sf_dir):
    return neardup.groups(table(spark, sf_dir, "documents"))


def op4_urlfilter(spark, sf_dir):
    return urlfilter.report(table(spark, sf_dir, "pages"))


def op5_packing(spark, sf_dir):
    packed = packing.pack(table(spark, sf_dir, "documents"))
    # the digest of the ids as they were written and read again
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_licenses(spark, sf_dir):
    return license.report(table(spark, sf_dir, "documents"))


def op7_maxent(spark, sf_dir):
    return maxent.score(table(spark, sf_dir, "documents"))


def op8_quality(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_tiff(spark, sf_dir):
    stored = tiff.fingerprint(tiff.store(table(spark, sf_dir, "documents")))
    return tiff.digests(tiff.pages(stored, "media", keep=["doc_id", "n_bytes", "media_bytes", "media_sha256"]))


def op10_warc(spark, sf_dir):
    return warc.report(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_surrogates, op3_neardup, op4_urlfilter, op5_packing, op6_licenses, op7_maxent, op8_quality, op9_tiff, op10_warc)}
SQL = {"op1_decontamination": decontam.SQL, "op3_neardup": neardup.SQL, "op10_warc": warc.SQL}
