"""The command line: bake a lake, ask it, explain a statement, list its tables."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from stratalake.plans.config import ConfigError, load
from stratalake.plans.lake import Lake, LakeError, TSqlError


def arguments() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("layers", nargs="*", help="layer directories, lowest first; they replace those of the file")
    shared.add_argument("--config", "-c", help="configuration file")
    shared.add_argument("--write", "-w", help="the topmost layer, which takes writes")
    shared.add_argument("--key", "-k", action="append", help="column of the default key; repeatable")
    shared.add_argument("--dacpac", help="declared schema")
    p = argparse.ArgumentParser(prog="stratalake", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    bake = verbs.add_parser("bake", parents=[shared], help="collapse the stack into one layer")
    bake.add_argument("--out", required=True, help="target directory")
    bake.add_argument("--database", action="store_true", help="with keys, rules and defaults, to be served as base")
    for name, text in (("query", "run a batch and print its rows"), ("explain", "print the steps of a batch")):
        v = verbs.add_parser(name, parents=[shared], help=text)
        v.add_argument("--sql", help="Spark SQL")
        v.add_argument("--tsql", help="T-SQL")
    verbs.add_parser("tables", parents=[shared], help="list tables, their files and columns")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(argv)
    try:
        config = load(a.config, layers=a.layers or None, write=a.write, defaultKey=a.key, dacpac=a.dacpac)
        if a.verb in ("query", "explain") and (a.sql is None) == (a.tsql is None):
            raise ConfigError("give one of --sql and --tsql")
    except ConfigError as e:
        print(e, file=sys.stderr)
        return e.exit_code
    spark = spark or SparkSession.builder.appName("stratalake").getOrCreate()
    try:
        with Lake(spark, config) as lake:
            if a.verb == "bake":
                (lake.bake_database if a.database else lake.bake)(a.out)
            elif a.verb == "tables":
                print("\n".join(lake.describe()))
            else:
                s = lake.session()
                if a.verb == "explain":
                    df = s.explain(a.tsql if a.tsql is not None else a.sql)
                else:
                    df = s.tsql(a.tsql) if a.tsql is not None else s.sql(a.sql)
                if df is not None:
                    print("\t".join(df.columns))
                    for row in df.toLocalIterator():
                        print("\t".join("" if v is None else str(v) for v in row))
    except (LakeError, TSqlError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0
