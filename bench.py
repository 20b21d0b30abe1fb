"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp())
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from stratalake.plans import registry

    took: dict[str, float] = {}

    def timed(name: str, f, runs: int = 3) -> None:
        best = None
        for _ in range(runs):
            t = time.time()
            f()
            best = min(best or 1e9, time.time() - t)
        took[name] = round(best, 4)

    from stratalake.plans.lake import Lake

    # the layers are laid down before anything is timed
    stack = registry.stacked(spark, SF).config.layers
    options = {"layers": stack, "defaultKey": "o_orderkey"}
    folder = registry.work(spark)
    opened: dict[str, Lake] = {}

    def start(mode: str, **more) -> None:
        opened[mode] = Lake(spark, **more)

    Lake(spark, **options).session().tsql("SELECT COUNT(*) AS n FROM orders").collect()  # compiles what all runs share
    timed("start_layers", lambda: start("merged", **options))
    timed("start_materialize", lambda: start("materialized", materialize=True, **options))
    timed("start_materialize_lazy", lambda: start("lazy", materialize=True, lazy=True, **options))
    timed("bake", lambda: opened["merged"].bake_database(folder), 1)
    timed("start_baked", lambda: start("baked", base=folder))
    modes = {m: opened[m].session() for m in ("merged", "materialized", "baked")}
    for mode, s in modes.items():
        timed(f"{mode}_key_lookup", lambda s=s: s.tsql("SELECT * FROM orders WHERE o_orderkey = 4242").collect())
        timed(f"{mode}_other_filter", lambda s=s: s.tsql("SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > 400000").collect())
        timed(f"{mode}_aggregate", lambda s=s: s.tsql("SELECT o_orderstatus, SUM(o_totalprice) AS p FROM orders GROUP BY o_orderstatus").collect())
    s = modes["merged"]
    for t in ("customer", "nation"):
        s.spark.read.parquet(f"{SF}/{t}.parquet").createOrReplaceTempView(t)
    timed("three_way_join", lambda: s.sql("SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name").collect())
    plain = registry.plain(spark, SF).session()
    timed("q1", lambda: plain.tsql("SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS q, SUM(l_extendedprice * (1 - l_discount)) AS p, COUNT_BIG(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus").collect())
    timed("top_orders", lambda: plain.tsql("SELECT TOP 10 o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey").collect())
    # each update is the first write of a lake of its own, opened before
    fresh = iter([Lake(spark, **options).session() for _ in range(3)])
    timed("update_by_key", lambda: next(fresh).tsql("UPDATE orders SET o_totalprice = 1 WHERE o_orderkey = 4242"))
    spark.stop()
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF}))


if __name__ == "__main__":
    main()
