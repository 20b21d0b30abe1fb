"""Registered queries over the driver's tables, and the SQL that states their results."""

from __future__ import annotations

import os
import tempfile
import uuid

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.operators import state
from stratalake.plans.lake import Lake
from stratalake.sources import layers as L
from stratalake.sources.schema import Declared, Reference, Schema

_lakes: dict[tuple[str, str], Lake] = {}


def plain(spark: SparkSession, sf_dir: str) -> Lake:
    """The driver's tables as a lake of one layer."""
    k = (spark.sparkContext.applicationId, sf_dir)
    if k not in _lakes:
        _lakes[k] = Lake(spark, layers=[sf_dir])
    return _lakes[k]


def work(spark: SparkSession) -> str:
    """A new folder for layers, beside the other scratch tables."""
    base = state.root(spark).removeprefix("file://")
    path = f"{base}/layers-{uuid.uuid4().hex[:10]}" if base.startswith("/") else tempfile.mkdtemp()
    os.makedirs(path)
    return path


def src(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def put(df: DataFrame, path: str, kind: str = "parquet", key: str | None = None) -> None:
    """A layer file of a table; Parquet as a directory of parts."""
    if kind == "parquet":
        df.write.parquet(path)
    else:
        L.write_file(df, f"{path}.{kind}", kind, key)


def orders(spark, sf_dir):
    return src(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def stacked(spark: SparkSession, sf_dir: str, **options) -> Lake:
    """orders in two layers: all rows, and every seventh key with its price raised by one."""
    d = work(spark)
    o = orders(spark, sf_dir)
    put(o, f"{d}/base/orders")
    put(o.filter("o_orderkey % 7 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1), f"{d}/top/orders")
    return Lake(spark, layers=[f"{d}/base", f"{d}/top"], defaultKey="o_orderkey", **options)


SHADOWED = "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per nation over the merged orders, their customers and nations."""
    lake = stacked(spark, sf_dir)
    s = lake.session()
    for t in ("customer", "nation"):
        s.spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return s.sql("SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")


QUERIES: dict = {"layered_revenue": flagship}
SQL: dict = {"layered_revenue": f"SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM ({SHADOWED}) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name"}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ layers
@query(SHADOWED)
def layer_shadow_by_key(spark, sf_dir):
    return stacked(spark, sf_dir).frame("orders")


@query("SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_nationkey < 5")
def layer_concat_no_key(spark, sf_dir):
    d, n = work(spark), src(spark, sf_dir, "nation")
    put(n, f"{d}/a/nation")
    put(n.filter("n_nationkey < 5"), f"{d}/b/nation")
    return Lake(spark, layers=[f"{d}/a", f"{d}/b"]).frame("nation")


@query("SELECT n_nationkey, CASE WHEN n_nationkey >= 10 THEN n_name END AS n_name, CASE WHEN n_nationkey < 10 THEN n_regionkey END AS n_regionkey FROM nation")
def layer_union_columns(spark, sf_dir):
    d, n = work(spark), src(spark, sf_dir, "nation")
    put(n.filter("n_nationkey < 10").select("n_nationkey", "n_regionkey"), f"{d}/a/nation")
    put(n.filter("n_nationkey >= 10").select("n_nationkey", "n_name"), f"{d}/b/nation")
    return Lake(spark, layers=[f"{d}/a", f"{d}/b"], defaultKey="n_nationkey").frame("nation")


@query("SELECT r_regionkey, r_name FROM region")
def layer_parquet_type_wins(spark, sf_dir):
    d, r = work(spark), src(spark, sf_dir, "region")
    put(r.filter("r_regionkey < 2"), f"{d}/a/region")
    put(r.filter("r_regionkey >= 2"), f"{d}/b/region", "json")
    return Lake(spark, layers=[f"{d}/a", f"{d}/b"], defaultKey="r_regionkey").frame("region")


def _file_layer(kind: str, table: str, key: str | None = None, keyed: bool = False):
    def run(spark, sf_dir):
        d = work(spark)
        put(src(spark, sf_dir, table), f"{d}/a/{table}", kind, key if keyed else None)
        return Lake(spark, layers=[f"{d}/a"], **({"defaultKey": key} if key else {})).frame(table)

    return run


query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region", "layer_yaml")(_file_layer("yaml", "region"))
query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation", "layer_json")(_file_layer("json", "nation"))
query("SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier", "layer_keyed_yaml")(_file_layer("yaml", "supplier", "s_suppkey", True))
query("SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier", "layer_keyed_json")(_file_layer("json", "supplier", "s_suppkey", True))


@query("SELECT * FROM customer")
def layer_directory(spark, sf_dir):
    d = work(spark)
    src(spark, sf_dir, "customer").repartition(3).write.parquet(f"{d}/a/customer")
    return Lake(spark, layers=[f"{d}/a"]).frame("customer")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS db FROM customer")
def layer_partition_above(spark, sf_dir):
    d, c = work(spark), src(spark, sf_dir, "customer")
    for i, v in enumerate(("even", "odd")):
        put(c.filter(f"c_custkey % 2 = {i}"), f"{d}/a/db={v}/customer")
    return Lake(spark, layers=[f"{d}/a"], defaultKey="c_custkey").frame("customer")


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def layer_partition_below(spark, sf_dir):
    d = work(spark)
    orders(spark, sf_dir).write.partitionBy("o_orderstatus").parquet(f"{d}/a/orders")
    return Lake(spark, layers=[f"{d}/a"]).frame("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, 'EUR' AS currency, CAST(round(CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END * 100) AS BIGINT) AS cents FROM orders")
def virtual_columns(spark, sf_dir):
    tables = {"orders": {"columns": [{"name": "currency", "const": "EUR"}, {"name": "cents", "expr": "round(o_totalprice * 100)", "type": "BIGINT"}]}}
    return stacked(spark, sf_dir, tables=tables).frame("orders").select("o_orderkey", "o_totalprice", "currency", "cents")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def session_filter(spark, sf_dir):
    lake = stacked(spark, sf_dir, tables={"orders": {"filter": "o_orderstatus = getvariable('status')"}})
    return lake.session(status="F").sql("SELECT o_orderkey, o_orderstatus FROM orders")


def _declared(spark, sf_dir, **defaults):
    columns = [("c_custkey", "BIGINT"), ("c_name", "STRING"), ("c_note", "STRING"), ("c_token", "STRING")]
    return Schema({"customer": Declared("customer", columns, ["c_custkey"], defaults={"c_note": "('none')", **defaults})})


@query("SELECT c_custkey, c_name, 'none' AS c_note FROM customer")
def default_fill(spark, sf_dir):
    return Lake(spark, layers=[sf_dir], schema=_declared(spark, sf_dir)).frame("customer").select("c_custkey", "c_name", "c_note")


@query("SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS c_token FROM (SELECT c_custkey, substr(sha256('customer.c_token'), 1, 16) || lpad(lower(to_hex(c_custkey)), 16, '0') AS h FROM customer)")
def derived_id(spark, sf_dir):
    return Lake(spark, layers=[sf_dir], schema=_declared(spark, sf_dir, c_token="newid()"), deriveIds=True).frame("customer").select("c_custkey", "c_token")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
def declared_view(spark, sf_dir):
    views = {"big": "CREATE VIEW dbo.big AS SELECT o_orderkey, o_totalprice FROM dbo.open_orders WHERE o_totalprice > 100000", "open_orders": "SELECT * FROM dbo.orders WHERE o_orderstatus = 'O'"}
    return Lake(spark, layers=[sf_dir], schema=Schema(views=views)).session().tsql("SELECT * FROM dbo.big")


@query("SELECT c_custkey, CAST(c_custkey * 2 AS INTEGER) AS doubled, 'C' || CAST(c_custkey AS VARCHAR) || '!' AS tag FROM customer")
def declared_function(spark, sf_dir):
    fns = {"Amplified": ([("t", "STRING")], "STRING", "dbo.Tag(@t) + '!'"), "Doubled": ([("x", "BIGINT")], "INT", "@x * 2"), "Tag": ([("t", "STRING")], "STRING", "'C' + @t")}
    return Lake(spark, layers=[sf_dir], schema=Schema(functions=fns)).session().tsql("SELECT c_custkey, dbo.Doubled(c_custkey) AS doubled, dbo.Amplified(CAST(c_custkey AS varchar(20))) AS tag FROM dbo.customer")


# ------------------------------------------------------------------ modes
@query(SHADOWED)
def cache_read(spark, sf_dir):
    lake = stacked(spark, sf_dir, cache=work(spark))
    lake.frame("orders").count()
    return lake.frame("orders")


query(SHADOWED, "materialize_read")(lambda spark, sf_dir: stacked(spark, sf_dir, materialize=True).frame("orders"))
query(SHADOWED, "lazy_read")(lambda spark, sf_dir: stacked(spark, sf_dir, materialize=True, lazy=True).frame("orders"))


@query(SHADOWED)
def store_read(spark, sf_dir):
    d = work(spark)
    lake = stacked(spark, sf_dir, materialize=True, store=d, storeMode="keep")
    return Lake(spark, layers=lake.config.layers, defaultKey="o_orderkey", materialize=True, store=d, storeMode="keep").frame("orders")


@query(SHADOWED)
def bake_roundtrip(spark, sf_dir):
    d = work(spark)
    stacked(spark, sf_dir).bake(d)
    return Lake(spark, layers=[d], defaultKey="o_orderkey").frame("orders")


@query(SHADOWED)
def base_roundtrip(spark, sf_dir):
    d = work(spark)
    stacked(spark, sf_dir).bake_database(d)
    return Lake(spark, base=d).frame("orders")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 11 <> 0")
def flush_delta_restart(spark, sf_dir):
    w = work(spark)
    lake = stacked(spark, sf_dir, materialize=True, write=w, writeFormat="parquet")
    with lake:
        s = lake.session()
        s.tsql("UPDATE orders SET o_totalprice = 0 WHERE o_orderkey % 5 = 0; DELETE FROM orders WHERE o_orderkey % 11 = 0")
    return Lake(spark, layers=lake.config.layers, defaultKey="o_orderkey", materialize=True, write=w).frame("orders")


# ------------------------------------------------------------------ writes
def written(name: str, oracle: str | None, *statements: str, select: str = "SELECT * FROM orders"):
    def run(spark, sf_dir):
        s = stacked(spark, sf_dir).session()
        for x in statements:
            s.tsql(x)
        return s.tsql(select)

    query(oracle, name)(run)


COLS = "o_orderkey, o_custkey, o_orderstatus"
written("tombstone_delete", f"SELECT * FROM ({SHADOWED}) WHERE o_orderkey % 3 <> 0", "DELETE FROM orders WHERE o_orderkey % 3 = 0")
written("update_key", f"SELECT {COLS}, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM ({SHADOWED})", "UPDATE orders SET o_totalprice = o_totalprice * 2 WHERE o_orderstatus = 'F'")
written("update_from", f"SELECT {COLS}, CASE WHEN o_custkey % 2 = 0 THEN -1 ELSE o_totalprice END AS o_totalprice FROM ({SHADOWED})", "UPDATE o SET o_totalprice = -1 FROM orders o JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey % 2 = 0) c ON c.k = o.o_custkey")
written("key_move", f"SELECT o_orderkey + 1 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM ({SHADOWED})", "UPDATE orders SET o_orderkey = o_orderkey + 1")
written("insert_select", f"SELECT * FROM ({SHADOWED}) UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice FROM ({SHADOWED}) WHERE o_orderkey % 10 = 0", "INSERT INTO orders SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 = 0")
written("insert_values", f"SELECT * FROM ({SHADOWED}) UNION ALL SELECT * FROM (VALUES (900000001, 5, 'N', 1.5), (900000002, NULL, 'N', NULL)) v", "INSERT INTO orders (o_orderkey, o_custkey, o_orderstatus, o_totalprice) VALUES (900000001, 5, 'N', 1.5), (900000002, NULL, 'N', NULL)")
written("delete_using", f"SELECT * FROM ({SHADOWED}) WHERE o_custkey % 4 <> 1", "DELETE o FROM orders o JOIN (SELECT o_orderkey AS k FROM orders WHERE o_custkey % 4 = 1) d ON d.k = o.o_orderkey")
written("delete_top", f"SELECT * FROM ({SHADOWED}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 10)", "DELETE TOP (10) FROM orders WHERE o_orderstatus = 'O'")
written("delete_top_percent", f"SELECT * FROM ({SHADOWED}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r <= ceil(n * 15 / 100.0))", "DELETE TOP (15) PERCENT FROM orders")
written("merge_matched_update", f"SELECT {COLS}, CASE WHEN o_orderkey % 6 = 0 THEN 7 ELSE o_totalprice END AS o_totalprice FROM ({SHADOWED})", "MERGE INTO orders AS t USING (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 6 = 0) AS s ON t.o_orderkey = s.k WHEN MATCHED THEN UPDATE SET o_totalprice = 7;")
written("merge_insert", f"SELECT * FROM ({SHADOWED}) UNION ALL SELECT o_orderkey + 200000000, o_custkey, 'M', o_totalprice FROM ({SHADOWED}) WHERE o_orderkey % 20 = 0", "MERGE INTO orders AS t USING (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p FROM orders WHERE o_orderkey % 20 = 0) AS s ON 1 = 0 WHEN NOT MATCHED THEN INSERT (o_orderkey, o_custkey, o_orderstatus, o_totalprice) VALUES (s.k + 200000000, s.c, 'M', s.p);")
written("transaction_rollback", SHADOWED, "BEGIN TRAN; DELETE FROM orders WHERE o_orderkey % 2 = 0; ROLLBACK TRAN")
written("transaction_commit", f"SELECT * FROM ({SHADOWED}) WHERE o_orderkey % 2 <> 0", "BEGIN TRAN; DELETE FROM orders WHERE o_orderkey % 2 = 0; COMMIT TRAN")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 0")
def delete_output(spark, sf_dir):
    return stacked(spark, sf_dir).session().tsql("DELETE FROM orders OUTPUT DELETED.o_orderkey WHERE o_orderkey % 50 = 0")


@query(f"SELECT o_orderkey, o_totalprice + 5 AS price FROM ({SHADOWED}) WHERE o_orderkey % 50 = 0")
def update_output(spark, sf_dir):
    return stacked(spark, sf_dir).session().tsql("UPDATE orders SET o_totalprice = o_totalprice + 5 OUTPUT INSERTED.o_orderkey, INSERTED.o_totalprice AS price WHERE o_orderkey % 50 = 0")


@query("SELECT CAST(40 + row_number() OVER (ORDER BY r_name) AS BIGINT) AS id, r_name FROM region UNION ALL SELECT 40, 'first'")
def identity_insert(spark, sf_dir):
    d = work(spark)
    os.makedirs(f"{d}/a")
    open(f"{d}/a/places.yaml", "w").write(yaml.safe_dump([{"id": 40, "r_name": "first"}]))
    schema = Schema({"places": Declared("places", [("id", "BIGINT"), ("r_name", "STRING")], ["id"], identity="id")})
    s = Lake(spark, layers=[f"{d}/a"], schema=schema).session()
    s.bulk_insert("places", src(spark, sf_dir, "region").select("r_name").coalesce(1).sortWithinPartitions("r_name"))
    return s.tsql("SELECT * FROM places")


def _chain(spark, sf_dir, action: str) -> Lake:
    """nation, customer and orders with references that act on delete."""
    d = work(spark)
    for t, cols in (("nation", "n_nationkey n_name"), ("customer", "c_custkey c_nationkey c_name"), ("orders", "o_orderkey o_custkey o_totalprice")):
        put(src(spark, sf_dir, t).select(*cols.split()), f"{d}/a/{t}")
    schema = Schema(
        {
            "nation": Declared("nation", [("n_nationkey", "INT"), ("n_name", "STRING")], ["n_nationkey"]),
            "customer": Declared("customer", [("c_custkey", "BIGINT"), ("c_nationkey", "INT"), ("c_name", "STRING")], ["c_custkey"], defaults={"c_nationkey": "(0)"}),
            "orders": Declared("orders", [("o_orderkey", "BIGINT"), ("o_custkey", "BIGINT"), ("o_totalprice", "DOUBLE")], ["o_orderkey"]),
        },
        [Reference("fk_c", "customer", ["c_nationkey"], "nation", ["n_nationkey"], action), Reference("fk_o", "orders", ["o_custkey"], "customer", ["c_custkey"], "cascade" if action == "cascade" else "restrict")],
    )
    return Lake(spark, layers=[f"{d}/a"], schema=schema)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 4))")
def fk_cascade(spark, sf_dir):
    s = _chain(spark, sf_dir, "cascade").session()
    s.tsql("DELETE FROM nation WHERE n_nationkey IN (3, 4)")
    return s.tsql("SELECT o_orderkey, o_custkey FROM orders")


@query("SELECT c_custkey, CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS c_nationkey FROM customer")
def fk_set_null(spark, sf_dir):
    s = _chain(spark, sf_dir, "null").session()
    s.tsql("DELETE FROM nation WHERE n_nationkey = 3")
    return s.tsql("SELECT c_custkey, c_nationkey FROM customer")


@query("SELECT c_custkey, CASE WHEN c_nationkey <> 3 THEN c_nationkey ELSE 0 END AS c_nationkey FROM customer")
def fk_set_default(spark, sf_dir):
    s = _chain(spark, sf_dir, "default").session()
    s.tsql("DELETE FROM nation WHERE n_nationkey = 3")
    return s.tsql("SELECT c_custkey, c_nationkey FROM customer")


@query("SELECT '23503' AS sqlstate, CAST(547 AS INTEGER) AS number, count(*) AS nations FROM nation")
def fk_restrict(spark, sf_dir):
    s = _chain(spark, sf_dir, "restrict").session()
    try:
        s.tsql("DELETE FROM nation WHERE n_nationkey = 3")
        found = ("none", 0)
    except Exception as e:
        found = (e.sqlstate, e.number)
    return s.sql(f"SELECT '{found[0]}' AS sqlstate, {found[1]} AS number, count(*) AS nations FROM nation")


# ------------------------------------------------------------------ the dialect
def dialect(name: str, tsql: str, oracle: str | None = None, params: dict | None = None):
    def run(spark, sf_dir):
        return plain(spark, sf_dir).session().tsql(tsql, params)

    query(oracle or tsql, name)(run)


dialect("tsql_where_predicates", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND NOT (o_orderstatus = 'F') AND o_custkey BETWEEN 10 AND 900 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate IS NOT NULL")
dialect("tsql_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'X!_%' ESCAPE '!'")
dialect("tsql_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
dialect("tsql_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
dialect("tsql_not_in_null_all", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_custkey < 5 THEN NULL ELSE o_custkey END FROM orders)")
dialect("tsql_case_iif", "SELECT o_orderkey, IIF(o_totalprice > 100000, 'big', 'small') AS size, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code FROM orders")
dialect("tsql_scalar_subquery", "SELECT o_orderkey, o_totalprice - (SELECT MIN(o_totalprice) FROM orders) AS above FROM orders")
dialect("tsql_cte", "WITH big (k, p) AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 150000), n AS (SELECT k, COUNT_BIG(*) AS c FROM big GROUP BY k) SELECT k, c FROM n WHERE c > 1", "WITH big AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 150000) SELECT k, count(*) AS c FROM big GROUP BY k HAVING count(*) > 1")
dialect("tsql_derived_columns", "SELECT d.k, d.v FROM (SELECT n_nationkey, n_name FROM nation) AS d (k, v)", "SELECT n_nationkey AS k, n_name AS v FROM nation")
dialect("tsql_join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o INNER HASH JOIN customer c WITH (NOLOCK) ON c.c_custkey = o.o_custkey", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey")
dialect("tsql_join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT OUTER JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 150000")
dialect("tsql_join_right", "SELECT c.c_custkey, n.n_name FROM customer c RIGHT JOIN nation n ON n.n_nationkey = c.c_nationkey AND c.c_acctbal > 9000")
dialect("tsql_join_full", "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL OUTER JOIN supplier s ON s.s_suppkey = c.c_custkey")
dialect("tsql_join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n WHERE r.r_regionkey < 2")
dialect("tsql_join_comma", "SELECT r.r_name, n.n_name FROM region r, nation n WHERE r.r_regionkey = n.n_regionkey")
dialect("tsql_join_nested", "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c LEFT JOIN nation n INNER JOIN region r ON r.r_regionkey = n.n_regionkey AND r.r_regionkey > 1 ON n.n_nationkey = c.c_nationkey", "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c LEFT JOIN (nation n JOIN region r ON r.r_regionkey = n.n_regionkey AND r.r_regionkey > 1) ON n.n_nationkey = c.c_nationkey")
dialect("tsql_join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
dialect("tsql_group_having", "SELECT l_returnflag, l_linestatus, COUNT_BIG(*) AS n, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 10", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1, 2 HAVING count(*) > 10")
dialect("tsql_cube", "SELECT l_returnflag, l_linestatus, COUNT_BIG(*) AS n FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)")
dialect("tsql_rollup", "SELECT l_returnflag, l_linestatus, COUNT_BIG(*) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)")
dialect("tsql_count_distinct", "SELECT COUNT(DISTINCT o_custkey) AS customers, COUNT(*) AS n, COUNT(o_orderpriority) AS p FROM orders", "SELECT CAST(count(DISTINCT o_custkey) AS INTEGER) AS customers, CAST(count(*) AS INTEGER) AS n, CAST(count(o_orderpriority) AS INTEGER) AS p FROM orders")
dialect("tsql_sum_wide", "SELECT n_regionkey, CAST(SUM(n_nationkey) AS bigint) AS s FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation GROUP BY n_regionkey")
dialect("tsql_avg_decimal", "SELECT o_orderstatus, ROUND(AVG(CAST(o_custkey AS decimal(18,2))), 4) AS a FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(avg(CAST(o_custkey AS DOUBLE)), 4) AS a FROM orders GROUP BY o_orderstatus")
dialect("tsql_statistics", "SELECT ROUND(STDEV(l_quantity), 6) AS s, ROUND(VARP(l_quantity), 6) AS v, MIN(l_tax) AS lo, MAX(l_tax) AS hi FROM lineitem", "SELECT round(stddev_samp(l_quantity), 6) AS s, round(var_pop(l_quantity), 6) AS v, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem")
OVER = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"
NULLS = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST)"
dialect("tsql_row_number", f"SELECT o_orderkey, ROW_NUMBER() {OVER} AS r FROM orders", f"SELECT o_orderkey, row_number() {NULLS} AS r FROM orders")
dialect("tsql_rank", "SELECT o_orderkey, RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS r, DENSE_RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS d FROM orders")
dialect("tsql_lag_lead", f"SELECT o_orderkey, LAG(o_totalprice) {OVER} AS before, LEAD(o_totalprice, 2) {OVER} AS after FROM orders", f"SELECT o_orderkey, lag(o_totalprice) {NULLS} AS before, lead(o_totalprice, 2) {NULLS} AS after FROM orders")
dialect("tsql_running_sum", f"SELECT o_orderkey, ROUND(SUM(o_totalprice) {OVER}, 2) AS s, FIRST_VALUE(o_orderkey) {OVER} AS f FROM orders", f"SELECT o_orderkey, round(sum(o_totalprice) {NULLS}, 2) AS s, first_value(o_orderkey) {NULLS} AS f FROM orders")
dialect("tsql_ntile", "SELECT o_orderkey, NTILE(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS q FROM orders")
dialect("tsql_top", "SELECT TOP 10 o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
dialect("tsql_top_percent", "SELECT TOP (3) PERCENT o_orderkey FROM orders ORDER BY o_orderkey", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r <= ceil(n * 3 / 100.0)")
dialect("tsql_offset_fetch", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 20 ROWS FETCH NEXT 15 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 20")
dialect("tsql_order_nulls_last", "SELECT TOP 30 k, v FROM (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS v FROM nation) d ORDER BY v, k", "SELECT k, v FROM (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS v FROM nation) d ORDER BY v NULLS LAST, k LIMIT 30")
dialect("tsql_union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
dialect("tsql_union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
dialect("tsql_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
dialect("tsql_intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey FROM supplier")
dialect("tsql_set_precedence", "SELECT 1 AS k UNION SELECT 2 INTERSECT SELECT 3", "SELECT 1 AS k UNION SELECT 2 INTERSECT SELECT 3")
dialect("tsql_values", "SELECT v.a, v.b FROM (VALUES (1, 'x'), (2, 'y')) AS v (a, b)")
dialect("tsql_parameters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = @s AND o_custkey < @k", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 300", {"s": "F", "k": 300})
dialect("tsql_string_functions", "SELECT p_partkey, UPPER(p_name) AS u, SUBSTRING(p_name, 2, 3) AS s, REPLACE(p_brand, '#', '-') AS r, LEFT(p_type, 4) AS l, RIGHT(p_type, 3) AS e, REVERSE(p_brand) AS b, LTRIM(RTRIM(p_type)) AS t FROM part", "SELECT p_partkey, upper(p_name) AS u, substring(p_name, 2, 3) AS s, replace(p_brand, '#', '-') AS r, left(p_type, 4) AS l, right(p_type, 3) AS e, reverse(p_brand) AS b, ltrim(rtrim(p_type)) AS t FROM part")
dialect("tsql_charindex_len", "SELECT p_partkey, CHARINDEX('a', p_name) AS i, LEN(p_name + '  ') AS n, ISNULL(NULL, p_brand) AS b FROM part", "SELECT p_partkey, CAST(instr(p_name, 'a') AS INTEGER) AS i, CAST(length(rtrim(p_name)) AS INTEGER) AS n, p_brand AS b FROM part")
dialect("tsql_concat_plus", "SELECT c_custkey, c_name + ':' + c_mktsegment AS a, CONCAT(c_name, NULL, c_custkey) AS b FROM customer", "SELECT c_custkey, c_name || ':' || c_mktsegment AS a, c_name || CAST(c_custkey AS VARCHAR) AS b FROM customer")
dialect("tsql_math", "SELECT p_partkey, CEILING(p_retailprice) AS c, FLOOR(p_retailprice) AS f, ROUND(p_retailprice, 1) AS r, ABS(-p_size) AS a, SQUARE(p_size) AS q, SIGN(p_size - 20) AS s FROM part", "SELECT p_partkey, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, round(p_retailprice, 1) AS r, abs(-p_size) AS a, power(p_size, 2) AS q, CAST(sign(p_size - 20) AS DOUBLE) AS s FROM part")
for _p, _o in (("year", "date_diff('year', DATE '1995-06-17', CAST(o_orderdate AS DATE))"), ("quarter", "date_diff('quarter', DATE '1995-06-17', CAST(o_orderdate AS DATE))"), ("month", "date_diff('month', DATE '1995-06-17', CAST(o_orderdate AS DATE))"), ("day", "date_diff('day', DATE '1995-06-17', CAST(o_orderdate AS DATE))"), ("hour", "date_diff('hour', TIMESTAMP '1995-06-17', o_orderdate)"), ("second", "date_diff('second', TIMESTAMP '1995-06-17', o_orderdate)")):
    dialect(f"tsql_datediff_{_p}", f"SELECT o_orderkey, DATEDIFF({_p}, CAST('1995-06-17' AS date), o_orderdate) AS d FROM orders", f"SELECT o_orderkey, {_o} AS d FROM orders")
dialect("tsql_dateadd", "SELECT o_orderkey, DATEADD(month, 1, o_orderdate) AS m, DATEADD(day, -40, o_orderdate) AS d, DATEADD(hh, 30, o_orderdate) AS h FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS m, o_orderdate - INTERVAL 40 DAY AS d, o_orderdate + INTERVAL 30 HOUR AS h FROM orders")
dialect("tsql_datepart", "SELECT event_id, DATEPART(year, ts) AS y, DATEPART(qq, ts) AS q, DATEPART(mm, ts) AS m, DATEPART(dy, ts) AS dy, DATEPART(wk, ts) AS w, DATEPART(dw, ts) AS dw, DATEPART(hh, ts) AS h, DATEPART(mi, ts) AS mi, DATEPART(ss, ts) AS s FROM events", "SELECT event_id, date_part('year', ts) AS y, date_part('quarter', ts) AS q, date_part('month', ts) AS m, date_part('dayofyear', ts) AS dy, date_part('week', ts) AS w, date_part('dayofweek', ts) AS dw, date_part('hour', ts) AS h, date_part('minute', ts) AS mi, date_part('second', ts) AS s FROM events")
dialect("tsql_fromparts", "SELECT n_nationkey, DATEFROMPARTS(2000 + n_nationkey, 2, 3) AS d, DATETIMEFROMPARTS(2001, 1, 1 + n_nationkey, 4, 5, 6, 70) AS t FROM nation", "SELECT n_nationkey, make_date(2000 + n_nationkey, 2, 3) AS d, make_timestamp(2001, 1, 1 + n_nationkey, 4, 5, 6.07) AS t FROM nation")
for _k, _f in ((112, "%Y%m%d"), (103, "%d/%m/%Y"), (120, "%Y-%m-%d %H:%M:%S"), (107, "%b %d, %Y")):
    dialect(f"tsql_convert_style_{_k}", f"SELECT o_orderkey, CONVERT(varchar(30), o_orderdate, {_k}) AS s FROM orders", f"SELECT o_orderkey, strftime(o_orderdate, '{_f}') AS s FROM orders")
dialect("tsql_convert_parse", "SELECT o_orderkey, CONVERT(date, CONVERT(varchar(8), o_orderdate, 112), 112) AS d FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
dialect("tsql_bit_arithmetic", "SELECT b.doc_id, b.q * 2 + 1 AS x FROM (SELECT doc_id, CAST(quality AS bit) AS q FROM labels) b WHERE b.q = 1", "SELECT doc_id, CAST(quality * 2 + 1 AS INTEGER) AS x FROM labels WHERE quality = 1")
dialect("tsql_cast_rounding_all", "SELECT l_orderkey, l_linenumber, CAST(l_quantity / 4 AS int) AS h, CAST(CAST(l_quantity AS decimal(10,2)) / 4 AS bigint) AS d, CAST(CAST(l_quantity + 0.5 AS decimal(10,1)) AS int) AS u FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(l_quantity / 4 AS INTEGER) AS h, CAST(CAST(l_quantity AS DOUBLE) / 4 AS BIGINT) AS d, CAST(CAST(l_quantity + 0.5 AS DECIMAL(10,1)) AS INTEGER) AS u FROM lineitem")
dialect("tsql_division", "SELECT p_partkey, p_size / 4 AS a, (p_size % 7) AS m FROM part", "SELECT p_partkey, p_size / 4 AS a, p_size % 7 AS m FROM part")
dialect("tsql_openjson_with", "SELECT e.event_id, j.k FROM events e CROSS JOIN OPENJSON(e.props) WITH (k int) AS j", "SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k FROM events")
dialect("tsql_openjson_default", "SELECT e.event_id, j.[key] AS name, j.value AS v, j.type AS t FROM events e CROSS JOIN OPENJSON(e.props) AS j", "SELECT event_id, j.key AS name, CAST(j.value AS VARCHAR) AS v, 2 AS t FROM events, json_each(props) AS j")


@query("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY n_regionkey")
def select_into_temp(spark, sf_dir):
    s = plain(spark, sf_dir).session()
    s.tsql("SELECT n_nationkey, n_regionkey INTO #t FROM nation; DELETE FROM #t WHERE n_nationkey <= 3")
    return s.tsql("SELECT n_regionkey, COUNT_BIG(*) AS n FROM #t GROUP BY n_regionkey")


@query("SELECT n_name FROM nation WHERE n_nationkey = (SELECT max(n_nationkey) FROM nation)")
def assign_select(spark, sf_dir):
    s = plain(spark, sf_dir).session()
    s.tsql("SELECT @k = n_nationkey FROM nation ORDER BY n_nationkey")
    return s.tsql("SELECT n_name FROM nation WHERE n_nationkey = @k")


# ------------------------------------------------------------------ the SQL door
def door(name: str, sql: str, oracle: str | None = None):
    query(oracle or sql, name)(lambda spark, sf_dir: plain(spark, sf_dir).session().sql(sql))


door("sql_names_all", "SELECT o_orderkey FROM lake.orders", "SELECT o_orderkey FROM orders")
door("sql_semi_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
door("sql_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
door("sql_distinct_from", "SELECT n_nationkey FROM nation WHERE nullif(n_regionkey, 1) IS DISTINCT FROM 2")
door("sql_pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem) PIVOT (count(l_linenumber) FOR l_linestatus IN ('F' AS f, 'O' AS o))", "SELECT l_returnflag, nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE l_linestatus = 'O'), 0) AS o FROM lineitem GROUP BY l_returnflag")
door("sql_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")
door("sql_casts_ranges", "SELECT i::INT AS i, repeat('x', i::INT) AS x FROM range(5) t(i)", "SELECT i::INT AS i, repeat('x', i::INT) AS x FROM range(5) t(i)")
door("sql_frames", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM orders")
