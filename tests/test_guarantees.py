"""What holds between sessions, files and modes."""

import os
import threading

import pytest
from test_lake import lake, put, rows, stack  # noqa: F401

from stratalake.operators import state
from stratalake.plans import door
from stratalake.plans.lake import Lake, LakeError
from stratalake.sources import files
from stratalake.sources.schema import Declared, Reference, Schema


def wide(spark, tmp_path, **options):
    put(f"{tmp_path}/a/t.json", '[{"id": 1, "v": 0, "w": 0}, {"id": 2, "v": 0, "w": 0}]')
    return Lake(spark, layers=[f"{tmp_path}/a"], defaultKey="id", **options)


def test_a_write_that_comes_between_is_not_lost(spark, tmp_path, monkeypatch):
    """Another session commits while a statement has computed its rows and not stored them yet."""
    k = wide(spark, tmp_path)
    a, b = k.session(), k.session()
    save, done = state.counted, []

    def counted(df, name):
        out = save(df, name)
        if not done:
            done.append(1)
            b.tsql("UPDATE t SET w = 7 WHERE id = 1")
        return out

    monkeypatch.setattr(state, "counted", counted)
    with pytest.raises(LakeError) as e:
        a.tsql("UPDATE t SET v = 5 WHERE id = 1")
    assert e.value.sqlstate == "40001" and rows(k.frame("t")) == [(1, 0, 7), (2, 0, 0)]


@pytest.mark.parametrize("serial", [False, True])
def test_writes_of_many_threads(spark, tmp_path, serial):
    k = wide(spark, tmp_path, serializeTransactions=serial)
    sessions = [k.session() for _ in range(4)]

    def work(s):
        for _ in range(2):
            s.tsql("UPDATE t SET v = v + 1 WHERE id = 1")

    threads = [threading.Thread(target=work, args=(s,)) for s in sessions]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert rows(k.frame("t")) == [(1, 8, 0), (2, 0, 0)]


def test_a_failing_write_gives_its_turn_back(spark, tmp_path):
    k = wide(spark, tmp_path, serializeTransactions=True)
    s = k.session()
    with pytest.raises(LakeError):
        s.tsql("INSERT INTO t VALUES (1, 1, 1)")
    k.session().tsql("UPDATE t SET v = 1")
    assert rows(k.frame("t")) == [(1, 1, 0), (2, 1, 0)]


def test_long_chains_cascade(spark, tmp_path):
    """Forty levels of tables of two rows, each below the last."""
    names = [f"t{i}" for i in range(40)]
    for i, n in enumerate(names):
        put(f"{tmp_path}/a/{n}.json", f'[{{"id": 1, "up": {1 if i else "null"}}}, {{"id": 2, "up": {2 if i else "null"}}}]')
    tables = {n: Declared(n, [("id", "BIGINT"), ("up", "BIGINT")], ["id"]) for n in names}
    refs = [Reference(f"f{i}", names[i], ["up"], names[i - 1], ["id"], "cascade") for i in range(1, 40)]
    s = Lake(spark, layers=[f"{tmp_path}/a"], schema=Schema(tables, refs)).session()
    s.tsql("DELETE FROM t0 WHERE id = 1")
    assert rows(s.tsql("SELECT id FROM t39")) == [(2,)] == rows(s.tsql("SELECT id FROM t20"))


def test_bakes_say_what_they_leave_out(spark, stack, caplog):  # noqa: F811
    os.makedirs(f"{stack}/out/old")
    lake(spark, stack).bake(f"{stack}/out")
    assert "old" in caplog.text
    with pytest.raises(LakeError, match="inside a layer"):
        lake(spark, stack).bake(f"{stack}/base/out")


def test_layers_by_uri(spark, stack):  # noqa: F811
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shelf.link./in", f"file://{stack}")
    spark.range(3).selectExpr("id AS crate", "id * 2 AS kilos").write.parquet(f"{stack}/more/day=1/crates")
    want = rows(lake(spark, stack).frame("crates"))
    for root in (f"file://{stack}", "viewfs://shelf/in"):
        k = Lake(spark, layers=[f"{root}/base", f"{root}/top"], defaultKey="crate")
        assert rows(k.frame("crates")) == want
        assert rows(Lake(spark, layers=[f"{root}/more"], defaultKey="crate").frame("crates").select("crate", "day")) == [(0, 1), (1, 1), (2, 1)]
    assert files.remote("viewfs://x/y") and not files.remote("file:///x") and files.plain("file:///x") == "/x"


def test_files_with_hidden_names(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/p")
    os.makedirs(f"{tmp_path}/a")
    part = next(n for n in os.listdir(f"{tmp_path}/p") if n.startswith("part-"))
    os.rename(f"{tmp_path}/p/{part}", f"{tmp_path}/a/_t.parquet")
    assert Lake(spark, layers=[f"{tmp_path}/a"]).frame("_t").count() == 3


def test_large_writes_stay_in_several_files(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id AS v").write.parquet(f"{tmp_path}/a/t")
    options = {"layers": [f"{tmp_path}/a"], "defaultKey": "id", "write": f"{tmp_path}/w", "writeFormat": "parquet"}
    for turn in (1, 2):
        s = Lake(spark, **options).session()
        s.bulk_insert("t", spark.range(1000 * turn, 1000 * turn + 500).selectExpr("id", "id AS v").repartition(3))
        assert Lake(spark, **options).frame("t").count() == 1000 + 500 * turn
    assert os.path.isdir(f"{tmp_path}/w/t.parquet")
    s.tsql("DELETE FROM t WHERE id >= 1000")
    assert Lake(spark, **options).frame("t").count() == 1000


def test_literals_and_spellings():
    assert door.literals("SELECT 'a', 'it''s', X'41', 'b' -- 'c''d'") == "SELECT 'a', \"it's\", X'41', 'b' -- 'c''d'"
    assert door.literals("'say \"it''s\"'") == "concat('say \"it', \"'\", 's\"')"
    assert door.rewrite("SELECT a[1], [1, '[x]'] FROM t")[0] == "SELECT a[1], array(1, '[x]') FROM t"
    assert door.rewrite("SELECT {'a': [1], b: 'x:y'} FROM t")[0] == "SELECT named_struct('a', array(1), 'b', 'x:y') FROM t"
    assert door.rewrite("DELETE FROM t WHERE a = 'RETURNING x' RETURNING a, b AS c;") == ("DELETE FROM t WHERE a = 'RETURNING x' ", " a, b AS c")
