"""More registered queries: file rules, modes, rules on writes, refusals, and the corners of the dialect and of the SQL door."""

from __future__ import annotations

import json
import os
import zipfile

from pyspark.sql import functions as F

from stratalake.plans.lake import Lake
from stratalake.plans.registry import COLS, SHADOWED, dialect, door, orders, plain, put, query, src, stacked, work, written
from stratalake.sources.schema import Declared, Reference, Schema


def text(path: str, content: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(content)


# ------------------------------------------------------------------ files of a layer
@query("SELECT * FROM nation")
def layer_format_order(spark, sf_dir):
    """Of two files of one table in a layer the Parquet file is read."""
    d = work(spark)
    put(src(spark, sf_dir, "nation"), f"{d}/a/nation")
    os.rename(f"{d}/a/nation", f"{d}/a/nation.parquet")
    text(f"{d}/a/nation.yaml", "- {n_nationkey: 99, n_name: other, n_regionkey: 0}\n")
    return Lake(spark, layers=[f"{d}/a"]).frame("nation").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def layer_owned_partition(spark, sf_dir):
    """A layer below db=.. gains no such column; the partitions below its tables are columns."""
    d = work(spark)
    orders(spark, sf_dir).drop("o_custkey").write.partitionBy("o_orderstatus").parquet(f"{d}/db=acme/orders")
    return Lake(spark, layers=[f"{d}/db=acme"]).frame("orders")


@query("SELECT r_regionkey, r_name FROM region")
def layer_hidden_names(spark, sf_dir):
    """Directories that start with a dot are no tables, and no part of one."""
    d = work(spark)
    put(src(spark, sf_dir, "region"), f"{d}/a/region")
    put(src(spark, sf_dir, "nation"), f"{d}/a/.region")
    put(src(spark, sf_dir, "nation"), f"{d}/a/.old/nation")
    lake = Lake(spark, layers=[f"{d}/a"])
    assert list(lake.tables) == ["region"]
    return lake.frame("region")


@query("SELECT CAST(7 AS BIGINT) AS i, CAST(1.5 AS DOUBLE) AS f, true AS b, CAST(NULL AS VARCHAR) AS n, '07' AS q, 'yes' AS w, CAST(1000 AS DOUBLE) AS e")
def layer_scalar_types(spark, sf_dir):
    """Plain YAML scalars are null, booleans, numbers or text; quoted ones are text."""
    d = work(spark)
    text(f"{d}/a/t.yaml", "- {i: 7, f: 1.5, b: True, n: ~, q: '07', w: yes, e: 1e3}\n")
    return Lake(spark, layers=[f"{d}/a"]).frame("t")


@query("SELECT CAST(3 AS BIGINT) AS a, 'x' AS b UNION ALL SELECT CAST(4 AS BIGINT), NULL")
def layer_single_row(spark, sf_dir):
    """A mapping that is no list is one row."""
    d = work(spark)
    text(f"{d}/one/t.yaml", "a: 3\nb: x\n")
    text(f"{d}/two/t.json", '{"a": 4}')
    return Lake(spark, layers=[f"{d}/one", f"{d}/two"]).frame("t").select("a", "b")


@query("SELECT CAST(1 AS BIGINT) AS id, 'Rome' AS city, CAST(5 AS BIGINT) AS n UNION ALL SELECT 2, 'Oslo', 9")
def layer_nested_columns(spark, sf_dir):
    """Mappings inside rows are structs."""
    d = work(spark)
    text(f"{d}/a/t.json", json.dumps([{"id": 1, "at": {"city": "Rome", "n": 5}}, {"id": 2, "at": {"city": "Oslo", "n": 9}}]))
    return Lake(spark, layers=[f"{d}/a"]).session().sql("SELECT id, at.city AS city, at.n AS n FROM t")


@query("SELECT 'nation' AS name, '25 rows, 3 columns: n_nationkey, n_name, n_regionkey' AS shape UNION ALL SELECT 'region', '2 columns: r_regionkey, r_name'")
def describe_shapes(spark, sf_dir):
    """Lines of what a lake holds; rows are counted of seed files."""
    d = work(spark)
    put(src(spark, sf_dir, "nation"), f"{d}/a/nation", "json")
    put(src(spark, sf_dir, "region"), f"{d}/a/region")
    lines = Lake(spark, layers=[f"{d}/a"]).describe()
    return spark.createDataFrame([(x.split(" <- ")[0], x.rsplit("(", 1)[1].rstrip(")")) for x in lines], "name string, shape string")


@query("SELECT count(*) AS n FROM customer")
def tsql_read_parquet(spark, sf_dir):
    return plain(spark, sf_dir).session().tsql(f"SELECT COUNT_BIG(*) AS n FROM read_parquet('{sf_dir}/customer.parquet') AS c")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def bake_partitioned(spark, sf_dir):
    """A table with partitions is baked with the same directories."""
    d = work(spark)
    orders(spark, sf_dir).drop("o_custkey").write.partitionBy("o_orderstatus").parquet(f"{d}/a/orders")
    Lake(spark, layers=[f"{d}/a"]).bake(f"{d}/out")
    assert any(n.startswith("o_orderstatus=") for n in os.listdir(f"{d}/out/orders"))
    return Lake(spark, layers=[f"{d}/out"]).frame("orders")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN 'later' ELSE c_mktsegment END AS c_note FROM customer")
def bake_defers_defaults(spark, sf_dir):
    """A bake leaves missing values to the defaults of whoever reads it."""
    d = work(spark)
    c = src(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 1, F.col("c_mktsegment")).alias("c_note"))
    put(c, f"{d}/a/customer")

    def schema(default):
        return Schema({"customer": Declared("customer", [("c_custkey", "BIGINT"), ("c_name", "STRING"), ("c_note", "STRING")], ["c_custkey"], defaults={"c_note": default})})

    Lake(spark, layers=[f"{d}/a"], schema=schema("('now')")).bake(f"{d}/out")
    return Lake(spark, layers=[f"{d}/out"], schema=schema("('later')")).frame("customer")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 3, 'again'")
def declared_package(spark, sf_dir):
    """A declared schema found in a layer gives the table its key."""
    d = work(spark)
    put(src(spark, sf_dir, "nation").select("n_nationkey", "n_name"), f"{d}/a/nation")
    put(spark.createDataFrame([(3, "again")], "n_nationkey int, n_name string"), f"{d}/b/nation")

    def col(n, t):
        return f'<Entry><Element Type="SqlSimpleColumn" Name="[dbo].[nation].[{n}]"><Relationship Name="TypeSpecifier"><Entry><Element Type="SqlTypeSpecifier"><Relationship Name="Type"><Entry><References Name="[{t}]"/></Entry></Relationship></Element></Entry></Relationship></Element></Entry>'

    key = '<Element Type="SqlPrimaryKeyConstraint" Name="[dbo].[pk]"><Relationship Name="ColumnSpecifications"><Entry><Element Type="SqlIndexedColumnSpecification"><Relationship Name="Column"><Entry><References Name="[dbo].[nation].[n_nationkey]"/></Entry></Relationship></Element></Entry></Relationship><Relationship Name="DefiningTable"><Entry><References Name="[dbo].[nation]"/></Entry></Relationship></Element>'
    xml = f'<DataSchemaModel><Model><Element Type="SqlTable" Name="[dbo].[nation]"><Relationship Name="Columns">{col("n_nationkey", "int")}{col("n_name", "nvarchar")}</Relationship></Element>{key}</Model></DataSchemaModel>'
    with zipfile.ZipFile(f"{d}/a/m.dacpac", "w") as z:
        z.writestr("model.xml", xml)
    return Lake(spark, layers=[f"{d}/a", f"{d}/b"]).frame("nation")


@query(SHADOWED)
def layer_file_uri(spark, sf_dir):
    """Layers named by a URI."""
    lake = stacked(spark, sf_dir)
    return Lake(spark, layers=[f"file://{x}" for x in lake.config.layers], defaultKey="o_orderkey").frame("orders")


# ------------------------------------------------------------------ the merge
@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def layer_single_repeats(spark, sf_dir):
    """One layer alone keeps rows whose key repeats."""
    d = work(spark)
    put(src(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), f"{d}/a/lineitem")
    return Lake(spark, layers=[f"{d}/a"], defaultKey="l_orderkey").frame("lineitem")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT NULL, 'upper'")
def layer_null_keys(spark, sf_dir):
    """Null keys are equal: the upper one stands."""
    d, n = work(spark), src(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    put(n.unionByName(spark.createDataFrame([(None, "lower")], n.schema)), f"{d}/a/nation")
    put(spark.createDataFrame([(None, "upper")], n.schema), f"{d}/b/nation")
    return Lake(spark, layers=[f"{d}/a", f"{d}/b"], defaultKey="n_nationkey").frame("nation")


@query("SELECT r_regionkey, r_name, true AS has_file FROM region")
def virtual_file(spark, sf_dir):
    d = work(spark)
    put(src(spark, sf_dir, "region"), f"{d}/a/region")
    tables = {"region": {"columns": [{"name": "has_file", "expr": "_file LIKE '%/region/%'"}]}}
    return Lake(spark, layers=[f"{d}/a"], tables=tables).frame("region")


@query("SELECT 'region' AS t, count(*) AS n, 'x' AS tag, CAST(NULL AS VARCHAR) AS mark FROM region UNION ALL SELECT 'nation', count(*), NULL, 'y' FROM nation")
def virtual_global_columns(spark, sf_dir):
    """Columns of all tables, but for those excepted, or of the only ones named."""
    columns = [{"name": "tag", "const": "x", "except": ["nation"]}, {"name": "mark", "const": "y", "only": ["nation"]}]
    lake = Lake(spark, layers=[sf_dir], columns=columns)
    a, b = lake.frame("region"), lake.frame("nation")
    assert "mark" not in a.columns and "tag" not in b.columns
    one = a.groupBy("tag").agg(F.count("*").alias("n")).select(F.lit("region").alias("t"), "n", "tag", F.lit(None).cast("string").alias("mark"))
    return one.unionByName(b.groupBy("mark").agg(F.count("*").alias("n")).select(F.lit("nation").alias("t"), "n", F.lit(None).cast("string").alias("tag"), "mark"))


@query("SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_note FROM customer")
def default_that_fails(spark, sf_dir):
    """A default that cannot be evaluated is null."""
    schema = Schema({"customer": Declared("customer", [("c_custkey", "BIGINT"), ("c_note", "STRING")], ["c_custkey"], defaults={"c_note": "(no_such_function())"})})
    return Lake(spark, layers=[sf_dir], schema=schema).frame("customer")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders UNION ALL SELECT -1, 1.0, 'Z'")
def cache_sees_new_files(spark, sf_dir):
    """A file added below a partition directory is in the next cached read."""
    d = work(spark)
    o = orders(spark, sf_dir).drop("o_custkey")
    o.filter("o_orderkey % 2 = 0").write.partitionBy("o_orderstatus").parquet(f"{d}/a/orders")
    o.filter("o_orderkey % 2 = 1").write.partitionBy("o_orderstatus").parquet(f"{d}/b/orders")
    options = {"layers": [f"{d}/a", f"{d}/b"], "defaultKey": "o_orderkey", "cache": f"{d}/cache"}
    Lake(spark, **options).frame("orders").count()
    spark.createDataFrame([(-1, 1.0, "Z")], "o_orderkey long, o_totalprice double, o_orderstatus string").write.mode("append").partitionBy("o_orderstatus").parquet(f"{d}/b/orders")
    return Lake(spark, **options).frame("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("SELECT r_regionkey, upper(r_name) || '!' AS r_name FROM region")
def reload_sees_new_files(spark, sf_dir):
    d, r = work(spark), src(spark, sf_dir, "region")
    put(r, f"{d}/a/region", "json")
    lake = Lake(spark, layers=[f"{d}/a"])
    s = lake.session()
    s.sql("SELECT * FROM region").count()
    os.remove(f"{d}/a/region.json")
    put(r.withColumn("r_name", F.concat(F.upper("r_name"), F.lit("!"))), f"{d}/a/region", "json")
    s.sql("CALL reload()")
    return s.sql("SELECT CAST(r_regionkey AS INT) AS r_regionkey, r_name FROM region")


# ------------------------------------------------------------------ what is refused
def failing(name: str, run, sqlstate: str | None = None, number: int | None = None, says: str = ""):
    """A query whose answer is the error that a statement ends in."""

    def outcome(spark, sf_dir):
        try:
            run(spark, sf_dir)
            found = ("none", 0, False)
        except Exception as e:
            found = (getattr(e, "sqlstate", "42000"), getattr(e, "number", 0), says.lower() in str(e).lower())
        return spark.createDataFrame([(found[0] if sqlstate else "", found[1] if number else 0, found[2])], "sqlstate string, number int, says boolean")

    query(f"SELECT '{sqlstate or ''}' AS sqlstate, CAST({number or 0} AS INTEGER) AS number, true AS says", name)(outcome)


def refusing(name: str, tsql: str, number: int | None = None, says: str = ""):
    failing(name, lambda spark, sf_dir: plain(spark, sf_dir).session().tsql(tsql), None, number, says)


refusing("refuse_merge_by_source", "MERGE INTO region AS t USING nation AS s ON t.r_regionkey = s.n_regionkey WHEN NOT MATCHED BY SOURCE THEN DELETE;")
refusing("refuse_apply", "SELECT a FROM region CROSS APPLY f(r_name)")
refusing("refuse_grouping_sets", "SELECT r_name FROM region GROUP BY GROUPING SETS ((r_name))")
refusing("refuse_frames", "SELECT SUM(r_regionkey) OVER (ORDER BY r_name ROWS 1 PRECEDING) AS s FROM region")
refusing("refuse_stuff", "SELECT STUFF(r_name, 1, 1, 'x') AS s FROM region", 195, "not a recognized")
refusing("refuse_ddl", "CREATE TABLE t (a int)")
refusing("refuse_as_json", "SELECT j.a FROM events CROSS JOIN OPENJSON(props) WITH (a nvarchar(max) AS JSON) AS j")
refusing("refuse_undeclared", "SELECT @nope AS x", 137, "must declare")
refusing("refuse_unknown_procedure", "EXEC no_such_procedure", 2812)
refusing("refuse_savepoint_rollback", "BEGIN TRAN; SAVE TRAN here; ROLLBACK TRAN here", 6401)
failing("refuse_duplicate_key", lambda spark, sf_dir: stacked(spark, sf_dir).session().tsql("INSERT INTO orders SELECT o_orderkey, o_custkey, o_orderstatus, 0 FROM orders"), "23505", 2627, "PRIMARY KEY")
failing("refuse_ambiguous_target", lambda spark, sf_dir: stacked(spark, sf_dir).session().tsql("UPDATE orders SET o_totalprice = 0 FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey"), None, 8154)
failing("refuse_virtual_column", lambda spark, sf_dir: stacked(spark, sf_dir, tables={"orders": {"columns": [{"name": "currency", "const": "EUR"}]}}).session().tsql("UPDATE orders SET currency = 'USD'"), "0A000", None, "virtual column")
failing("refuse_read_only", lambda spark, sf_dir: stacked(spark, sf_dir, writable=False).session().tsql("DELETE FROM orders"), "42501", 3906, "read-only")
failing("refuse_different_values", lambda spark, sf_dir: stacked(spark, sf_dir).session().tsql("UPDATE o SET o_totalprice = x.v FROM orders o JOIN (VALUES (1, 5), (1, 6)) x (k, v) ON x.k = o.o_orderkey"), "21000", 8672)


def _bake_inside(spark, sf_dir):
    lake = stacked(spark, sf_dir)
    lake.bake(f"{lake.config.layers[0]}/out")


failing("refuse_bake_inside_layer", _bake_inside, None, None, "inside a layer")


def _twice(spark, sf_dir):
    d = work(spark)
    put(src(spark, sf_dir, "nation"), f"{d}/a/nation")
    schema = Schema({"nation": Declared("nation", [("n_nationkey", "INT"), ("n_name", "STRING"), ("n_regionkey", "INT")], ["n_nationkey"], uniques=[["n_regionkey"]])})
    Lake(spark, layers=[f"{d}/a"], schema=schema, materialize=True)


failing("refuse_unique_at_collapse", _twice, "23505", 2627, "UNIQUE")


def _unique(spark, sf_dir):
    d = work(spark)
    put(src(spark, sf_dir, "nation"), f"{d}/a/nation")
    schema = Schema({"nation": Declared("nation", [("n_nationkey", "INT"), ("n_name", "STRING"), ("n_regionkey", "INT")], ["n_nationkey"], uniques=[["n_name"]])})
    s = Lake(spark, layers=[f"{d}/a"], schema=schema, materialize=True).session()
    s.tsql("INSERT INTO nation VALUES (90, NULL, 1), (91, NULL, 1)")
    s.tsql("UPDATE nation SET n_name = 'same' WHERE n_nationkey < 2")


failing("refuse_unique_on_write", _unique, "23505", 2627, "UNIQUE")


# ------------------------------------------------------------------ writes
@query(f"SELECT o_orderkey, o_custkey + 1 AS o_custkey, o_orderstatus, o_totalprice * 2 AS o_totalprice FROM ({SHADOWED})")
def writes_of_two_sessions(spark, sf_dir):
    """Two sessions that read before either wrote lose neither's change."""
    lake = stacked(spark, sf_dir)
    a, b = lake.session(), lake.session()
    for s in (a, b):
        s.tsql("SELECT COUNT(*) AS n FROM orders").collect()
    a.tsql("UPDATE orders SET o_custkey = o_custkey + 1")
    b.tsql("UPDATE orders SET o_totalprice = o_totalprice * 2")
    return a.tsql("SELECT * FROM orders")


def _overtaken(spark, sf_dir):
    lake = stacked(spark, sf_dir)
    a, b = lake.session(), lake.session()
    a.tsql("BEGIN TRAN; UPDATE orders SET o_totalprice = 5 WHERE o_orderkey = 1")
    b.tsql("UPDATE orders SET o_custkey = 7 WHERE o_orderkey = 1")
    a.tsql("COMMIT TRAN")


failing("refuse_overtaken_transaction", _overtaken, "40001", 3960, "another transaction")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey >= 1000000 THEN 'none' ELSE 'old' END AS c_note FROM (SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey + 1000000, c_name FROM customer)")
def default_on_write(spark, sf_dir):
    d = work(spark)
    put(src(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit("old").alias("c_note")), f"{d}/a/customer")
    schema = Schema({"customer": Declared("customer", [("c_custkey", "BIGINT"), ("c_name", "STRING"), ("c_note", "STRING")], ["c_custkey"], defaults={"c_note": "('none')"})})
    s = Lake(spark, layers=[f"{d}/a"], schema=schema).session()
    s.tsql("INSERT INTO customer (c_custkey, c_name) SELECT c_custkey + 1000000, c_name FROM customer")
    return s.tsql("SELECT * FROM customer")


def _notes(spark, sf_dir) -> Lake:
    """orders, and two notes for every third order."""
    d = work(spark)
    o = orders(spark, sf_dir)
    put(o, f"{d}/a/orders")
    some = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("order_id"))
    put(some.withColumn("note", F.lit("a")).unionByName(some.withColumn("note", F.lit("b"))), f"{d}/a/notes")
    return Lake(spark, layers=[f"{d}/a"], tables={"orders": {"key": "o_orderkey"}})


ORDERS = f"SELECT {COLS}, CASE WHEN {{0}} THEN {{1}} ELSE o_totalprice END AS o_totalprice FROM orders"
for _name, _sql, _when in (
    ("update_pruned_join", "UPDATE o SET o_totalprice = 5 FROM orders o LEFT JOIN notes n ON n.order_id = o.o_orderkey WHERE o.o_orderstatus = 'F'", "o_orderstatus = 'F'"),
    ("update_left_join", "UPDATE o SET o_totalprice = 5 FROM orders o LEFT JOIN notes n ON n.order_id = o.o_orderkey WHERE n.note IS NULL", "o_orderkey % 3 <> 0"),
    ("update_right_join", "UPDATE o SET o_totalprice = 5 FROM notes n RIGHT JOIN orders o ON n.order_id = o.o_orderkey WHERE n.note = 'b'", "o_orderkey % 3 = 0"),
    ("update_target_outside", "UPDATE o SET o_totalprice = 5 FROM notes n LEFT JOIN orders o ON n.order_id = o.o_orderkey AND o.o_orderstatus = 'O'", "o_orderkey % 3 = 0 AND o_orderstatus = 'O'"),
    ("update_full_join", "UPDATE o SET o_totalprice = 5 FROM notes n FULL JOIN orders o ON n.order_id = o.o_orderkey WHERE n.order_id IS NULL", "o_orderkey % 3 <> 0"),
):

    def _run(spark, sf_dir, sql=_sql):
        s = _notes(spark, sf_dir).session()
        s.tsql(sql)
        return s.tsql("SELECT * FROM orders")

    query(ORDERS.format(_when, 5), _name)(_run)


@query("SELECT n_nationkey, n_name FROM nation")
def fk_cycle_refuses(spark, sf_dir):
    """References that cascade in a circle refuse instead."""
    d = work(spark)
    n = src(spark, sf_dir, "nation").select("n_nationkey", "n_name", (F.col("n_nationkey") - 1).alias("up"))
    put(n.withColumn("up", F.when(F.col("up") >= 0, F.col("up"))), f"{d}/a/nation")
    schema = Schema({"nation": Declared("nation", [("n_nationkey", "INT"), ("n_name", "STRING"), ("up", "INT")], ["n_nationkey"])}, [Reference("fk", "nation", ["up"], "nation", ["n_nationkey"], "cascade")])
    s = Lake(spark, layers=[f"{d}/a"], schema=schema).session()
    try:
        s.tsql("DELETE FROM nation WHERE n_nationkey = 5")
    except Exception as e:
        assert e.number == 547, e
    return s.tsql("SELECT n_nationkey, n_name FROM nation")


@query("SELECT CAST(43 AS DECIMAL(38,0)) AS last, CAST(43 AS DECIMAL(38,0)) AS current")
def identity_last(spark, sf_dir):
    d = work(spark)
    text(f"{d}/a/t.json", '[{"id": 41, "label": "a"}]')
    schema = Schema({"t": Declared("t", [("id", "INT"), ("label", "STRING")], ["id"], identity="id")})
    s = Lake(spark, layers=[f"{d}/a"], schema=schema).session()
    s.tsql("INSERT INTO t (label) VALUES ('b'), ('c')")
    return s.tsql("SELECT SCOPE_IDENTITY() AS last, IDENT_CURRENT('dbo.t') AS [current]")


for _kind in ("json", "yaml", "parquet"):

    def _persist(spark, sf_dir, kind=_kind):
        d = work(spark)
        put(src(spark, sf_dir, "nation"), f"{d}/a/nation")
        options = {"layers": [f"{d}/a"], "defaultKey": "n_nationkey", "write": f"{d}/w", "writeFormat": kind}
        s = Lake(spark, **options).session()
        s.tsql("UPDATE nation SET n_name = 'x' WHERE n_regionkey = 1; DELETE FROM nation WHERE n_regionkey = 2; INSERT INTO nation VALUES (77, 'new', 0)")
        return Lake(spark, **options).frame("nation")

    query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'x' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 77, 'new', 0", f"persist_{_kind}")(_persist)


@query("SELECT n_nationkey, 'y' AS n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def flush_writes_differences(spark, sf_dir):
    """A flush leaves out rows that the layers hold as they are, and what was deleted before it was there."""
    d = work(spark)
    put(src(spark, sf_dir, "nation"), f"{d}/a/nation")
    with Lake(spark, layers=[f"{d}/a"], defaultKey="n_nationkey", materialize=True, write=f"{d}/w", writeFormat="parquet") as lake:
        lake.session().tsql("UPDATE nation SET n_name = n_name; UPDATE nation SET n_name = 'y' WHERE n_regionkey = 1; INSERT INTO nation VALUES (77, 'new', 0); DELETE FROM nation WHERE n_nationkey = 77")
    assert not os.path.exists(f"{d}/w/.deleted/nation.parquet")
    return spark.read.parquet(f"{d}/w/nation.parquet")


@query("SELECT o_orderkey, o_totalprice * 2 AS p FROM orders WHERE o_orderkey % 9 = 0")
def sql_returning(spark, sf_dir):
    d = work(spark)
    put(orders(spark, sf_dir), f"{d}/a/orders")
    return Lake(spark, layers=[f"{d}/a"], defaultKey="o_orderkey").session().sql("UPDATE orders SET o_totalprice = o_totalprice * 2 WHERE o_orderkey % 9 = 0 RETURNING o_orderkey, o_totalprice AS p")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000")
def sql_copy_to(spark, sf_dir):
    d = work(spark)
    n = plain(spark, sf_dir).session().sql(f"COPY (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000) TO '{d}/out' (FORMAT parquet)").first()[0]
    out = spark.read.parquet(f"{d}/out")
    assert n == out.count()
    return out


# ------------------------------------------------------------------ batches and sessions
@query("SELECT CAST(25 AS INTEGER) AS n, 'admin' AS who, CAST(0 AS INTEGER) AS trans, 5 AS still")
def tsql_session_values(spark, sf_dir):
    s = plain(spark, sf_dir).session()
    s.tsql("SET NOCOUNT ON; EXEC sp_getapplock; SELECT * INTO #t FROM nation; SELECT n_nationkey INTO #u FROM nation; DROP TABLE #u; DROP TABLE IF EXISTS #never")
    s.tsql("BEGIN TRAN; SAVE TRANSACTION here; ROLLBACK")
    return s.tsql("SELECT COUNT(*) AS n, SUSER_SNAME() AS who, @@TRANCOUNT AS trans, (SELECT COUNT(*) FROM region) AS still FROM #t")


@query("SELECT CAST(count(*) AS INTEGER) AS n FROM nation")
def tsql_rowcount(spark, sf_dir):
    s = plain(spark, sf_dir).session()
    s.tsql("SELECT * INTO #t FROM nation")
    return s.tsql("SELECT @@ROWCOUNT AS n")


@query("SELECT 'a' AS name, 'int' AS kind UNION ALL SELECT 'b', 'string' UNION ALL SELECT 'c', 'double'")
def describe_query(spark, sf_dir):
    """The columns of an answer without running it."""
    shape = plain(spark, sf_dir).session().describe("SELECT n_nationkey AS a, n_name AS b, n_nationkey / 2 AS c FROM nation")
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in shape], "name string, kind string")


@query("SELECT * FROM (VALUES ('server_encoding', 'UTF8'), ('tenant', 'x'), ('tenant', 'y'), ('tenant', 'x')) t(name, value)")
def show_set_reset(spark, sf_dir):
    s = plain(spark, sf_dir).session(tenant="x")
    out = [("server_encoding", s.sql("SHOW server_encoding").first()[0]), ("tenant", s.sql("SHOW tenant").first()[0])]
    s.sql("SET tenant = 'y'")
    out.append(("tenant", s.sql("SHOW tenant").first()[0]))
    s.sql("RESET ALL")
    return spark.createDataFrame([*out, ("tenant", s.sql("SHOW tenant").first()[0])], "name string, value string")


@query("SELECT 'check' AS step UNION ALL SELECT 'check' UNION ALL SELECT 'step' UNION ALL SELECT 'query' UNION ALL SELECT 'plan'")
def explain_steps(spark, sf_dir):
    s = stacked(spark, sf_dir, materialize=False).session()
    return s.explain("UPDATE orders SET o_totalprice = 1").select("step").unionAll(spark.createDataFrame([("check",)], "step string")).unionAll(s.explain("SELECT COUNT(*) AS n FROM orders").select("step"))


@query("SELECT 'orders' AS t, 'primary key' AS kind, 'o_orderkey' AS columns")
def catalog_constraints(spark, sf_dir):
    return spark.createDataFrame([(t, k, ",".join(c)) for t, k, c in stacked(spark, sf_dir).constraints()], "t string, kind string, columns string")


# ------------------------------------------------------------------ the dialect's corners
dialect("tsql_star_of", "SELECT n.*, r.r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey", "SELECT n.*, r.r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey")
dialect("tsql_empty_groups", "SELECT COUNT(*) AS n, SUM(n_nationkey) AS s, MAX(n_name) AS m FROM nation WHERE n_nationkey < 0", "SELECT CAST(count(*) AS INTEGER) AS n, CAST(NULL AS DECIMAL(38,0)) AS s, max(n_name) AS m FROM nation WHERE n_nationkey < 0")
dialect("tsql_analytic", "SELECT o_orderkey, ROUND(PERCENT_RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey), 9) AS p, ROUND(CUME_DIST() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey), 9) AS c, LAST_VALUE(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS l FROM orders", "SELECT o_orderkey, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c, last_value(o_orderkey) OVER w AS l FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)")
dialect("tsql_top_in_union", "SELECT TOP 1 MAX(o_orderkey) AS k FROM orders UNION ALL SELECT n_nationkey FROM nation UNION ALL SELECT TOP (100) PERCENT r_regionkey FROM region", "SELECT max(o_orderkey) AS k FROM orders UNION ALL SELECT n_nationkey FROM nation UNION ALL SELECT r_regionkey FROM region")
dialect("tsql_top_in_parts", "SELECT TOP 3 1 AS k FROM nation UNION ALL SELECT TOP 2 2 FROM nation", "SELECT * FROM (VALUES (1), (1), (1), (2), (2)) t(k)")
dialect("tsql_top_ties", "SELECT TOP 4 WITH TIES n_nationkey FROM nation ORDER BY n_nationkey", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 4")
dialect("tsql_except_some", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region")
dialect("tsql_literals", "SELECT N'it''s' AS a, 0x414243 AS b, 1.5e2 AS c, NULL AS d, -3 AS e, 'x' AS [f g] FROM region WHERE r_regionkey = 1", "SELECT 'it''s' AS a, 'ABC'::BLOB AS b, CAST(150 AS DOUBLE) AS c, NULL AS d, -3 AS e, 'x' AS \"f g\"")
dialect("tsql_modulo_zero", "SELECT n_nationkey, 7 % n_nationkey AS m, n_nationkey % (n_regionkey - 1) AS k, n_nationkey % 4 AS f FROM nation", "SELECT n_nationkey, CASE WHEN n_nationkey <> 0 THEN 7 % n_nationkey END AS m, CASE WHEN n_regionkey <> 1 THEN n_nationkey % (n_regionkey - 1) END AS k, n_nationkey % 4 AS f FROM nation")
dialect("tsql_division_zero", "SELECT n_nationkey, n_nationkey / (n_regionkey - 1) AS d FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey <> 1 THEN n_nationkey / (n_regionkey - 1) WHEN n_nationkey = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END AS d FROM nation")
dialect("tsql_bit_operators", "SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 9 AS o, ~n_nationkey AS n, n_nationkey ^ 5 AS x FROM nation", "SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 9 AS o, ~n_nationkey AS n, xor(n_nationkey, 5) AS x FROM nation")
dialect("tsql_pipes", "SELECT n_name || '-' || 'x' AS a FROM nation")
dialect("tsql_charindex_start", "SELECT p_partkey, CHARINDEX('a', p_name, 3) AS i FROM part", "SELECT p_partkey, CAST(CASE WHEN instr(substr(p_name, 3), 'a') > 0 THEN instr(substr(p_name, 3), 'a') + 2 ELSE 0 END AS INTEGER) AS i FROM part")
dialect("tsql_substring_edges", "SELECT n_nationkey, SUBSTRING(n_name, 0, 3) AS a, SUBSTRING(n_name, -1, 4) AS b, SUBSTRING(n_name, n_nationkey - 2, 4) AS c, LEFT(n_name, n_regionkey) AS l, RIGHT(n_name, n_regionkey) AS r FROM nation", "SELECT n_nationkey, substr(n_name, 1, 2) AS a, substr(n_name, 1, 2) AS b, CASE WHEN n_nationkey - 2 >= 1 THEN substr(n_name, n_nationkey - 2, 4) ELSE substr(n_name, 1, greatest(4 + n_nationkey - 3, 0)) END AS c, left(n_name, n_regionkey) AS l, right(n_name, n_regionkey) AS r FROM nation")
dialect("tsql_newid", "SELECT COUNT(DISTINCT d.x) AS n, COUNT(DISTINCT LEN(d.x)) AS k FROM (SELECT NEWID() AS x FROM nation) d", "SELECT CAST(count(*) AS INTEGER) AS n, CAST(1 AS INTEGER) AS k FROM nation")
dialect("tsql_string_agg", "SELECT n_regionkey, LEN(STRING_AGG(n_name, ',')) AS n, MIN_BY(n_name, n_nationkey) AS f FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(length(string_agg(n_name, ',')) AS INTEGER) AS n, min_by(n_name, n_nationkey) AS f FROM nation GROUP BY n_regionkey")
dialect("tsql_now", "SELECT DATEDIFF(hour, GETUTCDATE(), GETUTCDATE()) AS a, CASE WHEN DATEDIFF(day, GETDATE(), SYSDATETIME()) BETWEEN 0 AND 1 THEN 1 ELSE 0 END AS b, CASE WHEN GETDATE() > CAST('2020-01-01' AS datetime) THEN 1 ELSE 0 END AS c", "SELECT CAST(0 AS BIGINT) AS a, 1 AS b, 1 AS c")
dialect("tsql_datepart_small", "SELECT n_nationkey, DATEPART(ms, DATETIMEFROMPARTS(2001, 1, 1, 4, 5, 6, 70 + n_nationkey)) AS ms, DATEPART(mcs, DATETIMEFROMPARTS(2001, 1, 1, 4, 5, 6, n_nationkey)) AS mcs, DATEPART(ns, DATETIMEFROMPARTS(2001, 1, 1, 4, 5, 6, n_nationkey)) AS ns, DATENAME(mm, DATEFROMPARTS(2001, 1 + n_nationkey % 12, 1)) AS nm FROM nation", "SELECT n_nationkey, CAST(6070 + n_nationkey AS BIGINT) AS ms, CAST(6000000 + 1000 * n_nationkey AS BIGINT) AS mcs, CAST(6000000000 + 1000000 * CAST(n_nationkey AS BIGINT) AS BIGINT) AS ns, CAST(1 + n_nationkey % 12 AS BIGINT) AS nm FROM nation")
for _p, _o in (("week", "CAST(date_diff('day', DATE '1995-06-17', CAST(o_orderdate AS DATE)) AS BIGINT) // 7"), ("minute", "date_diff('minute', TIMESTAMP '1995-06-17', o_orderdate)"), ("millisecond", "date_diff('millisecond', TIMESTAMP '1995-06-17', o_orderdate)"), ("microsecond", "date_diff('microsecond', TIMESTAMP '1995-06-17', o_orderdate)"), ("dayofyear", "date_diff('day', DATE '1995-06-17', CAST(o_orderdate AS DATE))")):
    dialect(f"tsql_datediff_{_p}", f"SELECT o_orderkey, DATEDIFF({_p}, CAST('1995-06-17' AS date), o_orderdate) AS d FROM orders", f"SELECT o_orderkey, CASE WHEN '{_p}' = 'week' THEN CAST(trunc(date_diff('day', DATE '1995-06-17', CAST(o_orderdate AS DATE)) / 7) AS BIGINT) ELSE {_o} END AS d FROM orders")
dialect("tsql_dateadd_parts", "SELECT o_orderkey, DATEADD(yy, 2, o_orderdate) AS y, DATEADD(qq, -1, o_orderdate) AS q, DATEADD(wk, 3, o_orderdate) AS w, DATEADD(mi, 90, o_orderdate) AS n, DATEADD(ss, -5, o_orderdate) AS s, DATEADD(ms, 1500, o_orderdate) AS f FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 2 YEAR AS y, o_orderdate - INTERVAL 3 MONTH AS q, o_orderdate + INTERVAL 21 DAY AS w, o_orderdate + INTERVAL 90 MINUTE AS n, o_orderdate - INTERVAL 5 SECOND AS s, o_orderdate + INTERVAL 1500 MILLISECOND AS f FROM orders")
dialect("tsql_fromparts_more", "SELECT n_nationkey, DATETIME2FROMPARTS(2001, 2, 1 + n_nationkey, 4, 5, 6, 7, 3) AS a, SMALLDATETIMEFROMPARTS(2001, 2, 3, 4, n_nationkey) AS b, CAST(TIMEFROMPARTS(1, 2, 3, n_nationkey, 2) AS varchar(20)) AS c FROM nation", "SELECT n_nationkey, make_timestamp(2001, 2, 1 + n_nationkey, 4, 5, 6.007) AS a, make_timestamp(2001, 2, 3, 4, n_nationkey, 0.0) AS b, rtrim(rtrim('01:02:03.' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), '0'), '.') AS c FROM nation")
dialect("tsql_datetimeoffset", "SELECT n_nationkey, CAST(CAST(DATETIMEOFFSETFROMPARTS(2001, 2, 3, 14, 5, 6, 0, 2, 30, 3) AS datetime) AS varchar(30)) AS a FROM nation", "SELECT n_nationkey, '2001-02-03 11:35:06' AS a FROM nation")
_DATE = "o_orderdate"
for _k, _f in {1: "%m/%d/%y", 2: "%y.%m.%d", 3: "%d/%m/%y", 4: "%d.%m.%y", 5: "%d-%m-%y", 6: "%d %b %y", 7: "%b %d, %y", 8: "%H:%M:%S", 10: "%m-%d-%y", 11: "%y/%m/%d", 12: "%y%m%d", 14: "%H:%M:%S:%g", 20: "%Y-%m-%d %H:%M:%S", 21: "%Y-%m-%d %H:%M:%S.%g", 23: "%Y-%m-%d", 24: "%H:%M:%S", 25: "%Y-%m-%d %H:%M:%S.%g", 101: "%m/%d/%Y", 102: "%Y.%m.%d", 104: "%d.%m.%Y", 105: "%d-%m-%Y", 106: "%d %b %Y", 108: "%H:%M:%S", 110: "%m-%d-%Y", 111: "%Y/%m/%d", 113: "%d %b %Y %H:%M:%S:%g", 114: "%H:%M:%S:%g", 121: "%Y-%m-%d %H:%M:%S.%g", 126: "%Y-%m-%dT%H:%M:%S.%g", 127: "%Y-%m-%dT%H:%M:%S.%gZ"}.items():
    dialect(f"tsql_convert_style_{_k}", f"SELECT event_id, CONVERT(varchar(40), ts, {_k}) AS s FROM events", f"SELECT event_id, strftime(ts, '{_f}') AS s FROM events")
for _k in (23, 101, 103, 104, 110, 111, 120, 121):
    dialect(f"tsql_convert_parse_{_k}", f"SELECT o_orderkey, CONVERT(datetime, CONVERT(varchar(40), o_orderdate, {_k}), {_k}) AS d FROM orders", "SELECT o_orderkey, date_trunc('day', o_orderdate) AS d FROM orders" if _k < 120 else f"SELECT o_orderkey, date_trunc('{'second' if _k == 120 else 'millisecond'}', o_orderdate) AS d FROM orders")
dialect("tsql_password", "SELECT PWDCOMPARE('secret', PWDENCRYPT('secret')) AS a, PWDCOMPARE('other', PWDENCRYPT('secret')) AS b", "SELECT CAST(1 AS INTEGER) AS a, CAST(0 AS INTEGER) AS b")
dialect("tsql_openjson_kinds", "SELECT j.[key] AS k, j.value AS v, j.type AS t FROM region r CROSS JOIN OPENJSON('{\"a\": null, \"b\": \"x\", \"c\": 2, \"d\": true, \"e\": [1], \"f\": {\"g\": 1}}') AS j WHERE r.r_regionkey = 0 AND j.type <> 1", "SELECT * FROM (VALUES ('a', 'null', 0), ('c', '2', 2), ('d', 'true', 3), ('e', '[1]', 4), ('f', '{\"g\":1}', 5)) t(k, v, t)")


# ------------------------------------------------------------------ the SQL door's corners
door("sql_anti_join_rows", "SELECT n_nationkey FROM nation LEFT ANTI JOIN region ON r_regionkey = n_nationkey", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)")
door("sql_semi_join_rows", "SELECT n_nationkey FROM nation LEFT SEMI JOIN region ON r_regionkey = n_nationkey", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT r_regionkey FROM region)")
door("sql_set_all", "(SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region) UNION ALL (SELECT n_regionkey FROM nation INTERSECT ALL SELECT n_nationkey % 3 FROM nation)", "(SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region) UNION ALL (SELECT n_regionkey FROM nation INTERSECT ALL SELECT n_nationkey % 3 FROM nation)")
door("sql_nan_order", "SELECT row_number() OVER (ORDER BY x NULLS LAST) AS r, CASE WHEN isnan(x) THEN 'nan' ELSE CAST(CAST(x AS INT) AS STRING) END AS x FROM (SELECT CASE n_nationkey WHEN 0 THEN double('NaN') WHEN 1 THEN 1D WHEN 2 THEN -1D END AS x FROM nation WHERE n_nationkey < 4)", "SELECT * FROM (VALUES (CAST(1 AS INTEGER), '-1'), (2, '1'), (3, 'nan'), (4, NULL)) t(r, x)")
door("sql_materialized_cte", "WITH big AS MATERIALIZED (SELECT o_custkey FROM orders WHERE o_totalprice > 100000), few AS NOT MATERIALIZED (SELECT 1 AS x) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey")
door("sql_full_match", "SELECT p_partkey, regexp_full_match(p_brand, 'Brand#[1-3]+') AS a, regexp_extract(p_brand, '([0-9]+)', 1) AS b FROM part", "SELECT p_partkey, regexp_full_match(p_brand, 'Brand#[1-3]+') AS a, regexp_extract(p_brand, '([0-9]+)', 1) AS b FROM part")
door("sql_list_struct_literals", "SELECT n_nationkey, [n_nationkey, 5][1] AS five, {'a': n_name, 'b': [1, 2]}.a AS a, array_contains([1, 3], n_regionkey) AS c FROM nation", "SELECT n_nationkey, 5 AS five, n_name AS a, n_regionkey IN (1, 3) AS c FROM nation")
door("sql_ordered_list", "SELECT n_regionkey, array_join(list(n_name ORDER BY n_nationkey DESC), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY n_regionkey")
door("sql_star_replace", "SELECT * REPLACE (upper(n_name) AS n_name, n_nationkey + 1 AS n_nationkey) FROM nation")
door("sql_array_map_functions", "SELECT n_nationkey, size(split(n_name, 'I')) AS n, map('a', n_nationkey)['a'] AS m FROM nation", "SELECT n_nationkey, CAST(len(string_split(n_name, 'I')) AS INTEGER) AS n, n_nationkey AS m FROM nation")
door("sql_json_paths", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k FROM events")


@query("SELECT CAST(count(*) AS VARCHAR) AS n, CAST(min(n_nationkey) AS VARCHAR) AS lo, CAST(max(n_nationkey) AS VARCHAR) AS hi FROM nation")
def sql_summarize(spark, sf_dir):
    rows = {r["summary"]: r["n_nationkey"] for r in plain(spark, sf_dir).session().sql("SUMMARIZE nation").collect()}
    return spark.createDataFrame([(rows["count"], rows["min"], rows["max"])], "n string, lo string, hi string")


written("update_chain", f"SELECT {COLS}, o_totalprice + 3 AS o_totalprice FROM ({SHADOWED}) WHERE o_orderkey % 13 <> 0 UNION ALL SELECT -5, 1, 'N', 2.0", "UPDATE orders SET o_totalprice = o_totalprice + 1; UPDATE orders SET o_totalprice = o_totalprice + 2; DELETE FROM orders WHERE o_orderkey % 13 = 0; INSERT INTO orders VALUES (-5, 1, 'N', 2)")
