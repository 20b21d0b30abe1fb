"""Layers, keyed files, partitions, writes, rules and modes on small fixtures."""

import json
import os
import zipfile

import pytest

from stratalake.functions import host
from stratalake.plans.cli import main
from stratalake.plans.config import Config, ConfigError, load
from stratalake.plans.lake import Lake, LakeError
from stratalake.plans.tsql.parser import parse
from stratalake.sources.schema import Declared, Reference, Schema, read_package


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def stack(tmp_path):
    put(f"{tmp_path}/base/crates.yaml", "- {crate: 1, kilos: 15}\n- {crate: 2, kilos: 35}\n")
    put(f"{tmp_path}/top/crates.json", '[{"crate": 2, "kilos": 36}, {"crate": 3, "kilos": 48}]')
    return tmp_path


def lake(spark, stack, **options):
    return Lake(spark, layers=[f"{stack}/base", f"{stack}/top"], defaultKey="crate", **options)


def test_shadow_and_no_key(spark, stack):
    assert rows(lake(spark, stack).frame("crates")) == [(1, 15), (2, 36), (3, 48)]
    assert Lake(spark, layers=[f"{stack}/base", f"{stack}/top"]).frame("crates").count() == 4


def test_one_layer_keeps_repeated_keys(spark, tmp_path):
    put(f"{tmp_path}/a/t.yaml", "- {id: 1}\n- {id: 1}\n")
    assert Lake(spark, layers=[f"{tmp_path}/a"], defaultKey="id").frame("t").count() == 2


def test_scalars_keyed_files_and_partitions(spark, tmp_path):
    put(f"{tmp_path}/a/t.yaml", "one: {v: yes, n: 1.5, q: '7', z: ~}\ntwo: {v: no, n: 2, q: '8', z: x}\n")
    put(f"{tmp_path}/a/db=x/p.json", '[{"id": 1}]')
    put(f"{tmp_path}/a/db=y/p.json", '[{"id": 1}]')
    put(f"{tmp_path}/a/.hidden/h.json", '[{"id": 1}]')
    k = Lake(spark, layers=[f"{tmp_path}/a"], defaultKey="id")
    assert rows(k.frame("t")) == [("one", "yes", 1.5, "7", None), ("two", "no", 2.0, "8", "x")]
    assert rows(k.frame("p")) == [(1, "x"), (1, "y")] and k.tables["p"].key == ["id", "db"] and "h" not in k.tables


def test_filter_before_shadow(spark, stack):
    got = lake(spark, stack, tables={"crates": {"filter": "kilos <> 36"}}).frame("crates")
    assert rows(got) == [(1, 15), (2, 35), (3, 48)]


def test_key_predicate_reaches_the_scans(spark, tmp_path):
    for n in "ab":
        spark.range(100).selectExpr("id", "id * 2 AS v").write.parquet(f"{tmp_path}/{n}/t")
    df = Lake(spark, layers=[f"{tmp_path}/a", f"{tmp_path}/b"], defaultKey="id").frame("t").filter("id = 5").select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(id,5)") >= 2


@pytest.mark.parametrize("kind", ["json", "yaml", "parquet"])
def test_writes_survive_a_restart(spark, stack, kind):
    w = f"{stack}/w"
    s = lake(spark, stack, write=w, writeFormat=kind).session()
    s.tsql("INSERT INTO crates VALUES (4, 60); UPDATE crates SET kilos = 0 WHERE crate = 1; DELETE FROM crates WHERE crate = 3")
    want = [(1, 0), (2, 36), (4, 60)]
    assert rows(s.tsql("SELECT * FROM crates")) == want
    assert rows(lake(spark, stack, write=w).frame("crates")) == want
    lake(spark, stack, write=w).session().tsql("DELETE FROM crates")
    assert rows(lake(spark, stack, write=w).frame("crates")) == [] and not os.path.exists(f"{w}/crates.{kind}")


@pytest.mark.parametrize("modes", [{}, {"materialize": True}, {"materialize": True, "lazy": True}])
def test_modes_agree_after_writes(spark, stack, modes):
    with lake(spark, stack, write=f"{stack}/w", **modes) as k:
        k.session().tsql("UPDATE crates SET crate = crate + 1; DELETE TOP (1) FROM crates")
    for again in range(2):
        with lake(spark, stack, write=f"{stack}/w", **modes) as k:
            assert rows(k.frame("crates")) == [(3, 36), (4, 48)], again


def test_rules(spark, stack):
    s = lake(spark, stack).session()
    for text, number in (("INSERT INTO crates VALUES (1, 1)", 2627), ("INSERT INTO crates VALUES (9, 1), (9, 2)", 2627), ("INSERT INTO nothing VALUES (1)", 208), ("UPDATE crates SET nope = 1", 207)):
        with pytest.raises(LakeError) as e:
            s.tsql(text)
        assert e.value.number == number
    with pytest.raises(LakeError):
        s.tsql("UPDATE o SET kilos = x.v FROM crates o JOIN (VALUES (1, 5), (1, 6)) x (k, v) ON x.k = o.crate")
    assert rows(s.tsql("SELECT * FROM crates")) == [(1, 15), (2, 36), (3, 48)]


def test_two_transactions_on_one_table(spark, stack):
    k = lake(spark, stack)
    a, b = k.session(), k.session()
    a.tsql("BEGIN TRAN; DELETE FROM crates WHERE crate = 1")
    assert b.tsql("SELECT * FROM crates").count() == 3
    b.tsql("BEGIN TRAN; DELETE FROM crates WHERE crate = 2")
    a.tsql("COMMIT")
    with pytest.raises(LakeError) as e:
        b.tsql("COMMIT")
    assert e.value.sqlstate == "40001" and rows(k.frame("crates")) == [(2, 36), (3, 48)]


def test_cascade_and_self_reference(spark, tmp_path):
    put(f"{tmp_path}/a/nodes.json", json.dumps([{"id": 1, "up": None}, {"id": 2, "up": 1}, {"id": 3, "up": 2}]))
    schema = Schema({"nodes": Declared("nodes", [("id", "BIGINT"), ("up", "BIGINT")], ["id"])}, [Reference("fk", "nodes", ["up"], "nodes", ["id"])])
    s = Lake(spark, layers=[f"{tmp_path}/a"], schema=schema).session()
    with pytest.raises(LakeError):
        s.tsql("DELETE FROM nodes WHERE id = 2")
    s.tsql("DELETE FROM nodes WHERE id > 1")
    assert rows(s.tsql("SELECT id FROM nodes")) == [(1,)]


def test_identity_uniques_and_scope(spark, tmp_path):
    put(f"{tmp_path}/a/t.json", '[{"id": 41, "label": "a"}]')
    schema = Schema({"t": Declared("t", [("id", "INT"), ("label", "STRING")], ["id"], identity="id", uniques=[["label"]])})
    s = Lake(spark, layers=[f"{tmp_path}/a"], schema=schema, materialize=True).session()
    s.tsql("INSERT INTO t (label) VALUES ('b'), (NULL), (NULL)")
    assert [r[0] for r in s.tsql("SELECT id FROM t ORDER BY id").collect()] == [41, 42, 43, 44]
    assert int(s.tsql("SELECT SCOPE_IDENTITY() AS i").first()[0]) == 44
    with pytest.raises(LakeError, match="UNIQUE"):
        s.tsql("INSERT INTO t (label) VALUES ('a')")


def test_model_package(spark, tmp_path):
    col = lambda n, t, extra="": f'<Entry><Element Type="SqlSimpleColumn" Name="[dbo].[t].[{n}]">{extra}<Relationship Name="TypeSpecifier"><Entry><Element Type="SqlTypeSpecifier"><Relationship Name="Type"><Entry><References Name="[{t}]"/></Entry></Relationship></Element></Entry></Relationship></Element></Entry>'
    xml = f"""<DataSchemaModel><Model><Element Type="SqlTable" Name="[dbo].[t]"><Relationship Name="Columns">{col("id", "int")}{col("note", "nvarchar")}</Relationship></Element>
    <Element Type="SqlPrimaryKeyConstraint" Name="[dbo].[pk]"><Relationship Name="ColumnSpecifications"><Entry><Element Type="SqlIndexedColumnSpecification"><Relationship Name="Column"><Entry><References Name="[dbo].[t].[id]"/></Entry></Relationship></Element></Entry></Relationship><Relationship Name="DefiningTable"><Entry><References Name="[dbo].[t]"/></Entry></Relationship></Element>
    </Model></DataSchemaModel>"""
    os.makedirs(f"{tmp_path}/a")
    with zipfile.ZipFile(f"{tmp_path}/a/m.dacpac", "w") as z:
        z.writestr("model.xml", xml)
    assert read_package(f"{tmp_path}/a/m.dacpac").tables["t"].key == ["id"]
    k = Lake(spark, layers=[f"{tmp_path}/a"])
    k.session().tsql("INSERT INTO t VALUES (1, 'x')")
    assert rows(k.frame("t")) == [(1, "x")]


def test_configuration(tmp_path):
    put(f"{tmp_path}/lake.yaml", "layers: one\ndefaultKey: id\n")
    os.makedirs(f"{tmp_path}/one")
    c = load(f"{tmp_path}/lake.yaml", env={"LAKE_tables__t__key": "x"})
    assert c.layers == [f"{tmp_path}/one"] and c.defaultKey == ["id"] and c.tables == {"t": {"key": "x"}}
    for bad in ({"layers": ["/nowhere"]}, {"store": "s"}, {"lazy": True}, {"tdsPacketSize": 1}, {"storeMode": "keep"}):
        with pytest.raises(ConfigError):
            Config(**bad).validate()


def test_password_hash():
    assert host.matches("secret", host.encrypt("secret")) == 1 and host.matches("other", host.encrypt("secret")) == 0 and host.matches(None, b"") is None


def test_explain_names_steps(spark, stack):
    s = lake(spark, stack).session()
    assert [r[0] for r in s.explain("UPDATE crates SET kilos = 1").collect()] == ["check", "step"]
    assert "Window" in s.explain("SELECT * FROM crates").collect()[1][1]


def test_unread_outer_joins_leave_joined_writes(spark, stack):
    put(f"{stack}/base/notes.json", '[{"crate": 1, "note": "a"}, {"crate": 1, "note": "b"}]')
    s = lake(spark, stack, tables={"notes": {"key": ["note"]}}).session()

    def tree(text):
        n = parse(text)[0]
        return s.pruned(n, s.target(n)[1]).kind

    assert tree("DELETE o FROM crates o LEFT JOIN notes n ON n.crate = o.crate WHERE o.kilos > 35") == "table"
    assert tree("DELETE o FROM notes n RIGHT JOIN crates o ON n.crate = o.crate WHERE kilos > 35") == "table"
    for rest in ("LEFT JOIN notes n ON n.crate = o.crate WHERE n.note IS NULL", "LEFT JOIN notes n ON n.crate = o.crate WHERE note IS NULL", "JOIN notes n ON n.crate = o.crate"):
        assert tree(f"DELETE o FROM crates o {rest}") == "join"
    s.tsql("DELETE o FROM crates o LEFT JOIN notes n ON n.crate = o.crate LEFT JOIN notes m ON m.note = n.note WHERE o.kilos = 15")
    assert rows(s.tsql("SELECT crate FROM crates")) == [(2,), (3,)]
    s.tsql("UPDATE o SET kilos = 5 FROM crates o LEFT JOIN notes n ON n.crate = o.crate WHERE n.note IS NULL AND o.crate = 3")
    assert rows(s.tsql("SELECT * FROM crates")) == [(2, 36), (3, 5)]


def test_session_verbs(spark, stack):
    s = lake(spark, stack).session(tenant="x")
    assert s.sql("SHOW server_encoding").first()[0] == "UTF8" and s.sql("SHOW tenant").first()[0] == "x"
    s.sql("SET tenant = 'y'")
    assert s.sql("SHOW tenant").first()[0] == "y"
    assert s.sql("RESET tenant") is None and s.sql("SHOW tenant").first()[0] == "x"
    assert s.sql("DEALLOCATE ALL") is None and s.sql("SHOW TABLES").columns[-1] == "isTemporary"
    s.tsql("SELECT 1 AS a INTO #t")
    s.sql("DISCARD ALL")
    assert not s.temps
    assert [tuple(r)[:2] for r in s.tsql("EXEC ..sp_tablecollations_100 N'dbo.crates'").collect()] == [(1, "crate"), (2, "kilos")]
    assert s.describe("SELECT kilos AS a FROM crates").names == ["a"]


def test_command_line(spark, stack, capsys):
    layers = [f"{stack}/base", f"{stack}/top"]
    assert main(["bake", *layers, "--key", "crate", "--out", f"{stack}/baked"], spark) == 0
    assert main(["query", f"{stack}/baked", "--tsql", "SELECT COUNT(*) AS n FROM crates"], spark) == 0
    assert capsys.readouterr().out == "n\n3\n"
    assert main(["query", "/nowhere", "--sql", "SELECT 1"], spark) == 64 and main(["query", *layers], spark) == 64
    assert main(["query", *layers, "--tsql", "DELETE FROM crates"], spark) == 1


def test_a_kept_store_is_the_state(spark, stack):
    schema = Schema({"t": Declared("t", [("id", "INT"), ("label", "STRING")], ["id"], identity="id")})
    put(f"{stack}/base/t.json", '[{"id": 5, "label": "a"}]')
    options = {"materialize": True, "store": f"{stack}/kept", "write": f"{stack}/w"}

    def opened(**more):
        return lake(spark, stack, schema=schema, **{**options, **more})

    with opened() as k:
        k.session().tsql("INSERT INTO t (label) VALUES ('b'); UPDATE crates SET kilos = 0 WHERE crate = 1; DELETE FROM crates WHERE crate = 3; DELETE FROM t WHERE id = 6")
    assert not os.path.exists(f"{stack}/w/crates.json")
    put(f"{stack}/base/crates.yaml", "- {crate: 8, kilos: 80}\n")
    for lazy in (False, True):
        with opened(lazy=lazy) as k:
            assert rows(k.session().tsql("SELECT * FROM crates")) == [(1, 0), (2, 36)]
    with opened() as k:
        s = k.session()
        s.tsql("INSERT INTO t (label) VALUES ('c')")
        assert rows(s.tsql("SELECT id FROM t")) == [(5,), (7,)]
    put(f"{stack}/top/crates.json", '[{"crate": 2, "kilos": 36, "more": 1}]')
    with pytest.raises(LakeError, match="crates"):
        opened()
    assert rows(opened(store=f"{stack}/spilled", storeMode="spill").frame("crates").select("crate")) == [(2,), (8,)]
