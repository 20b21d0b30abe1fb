
import corpus_pipeline
import duckdb
import pytest
from test_operators import SF, docs

from stratalake.llm import license
from stratalake.plans import registry


# ------------------------------------------------------------------ near-dedup stage
def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_neardup_stage_takes_pairs_from_four_fifths(spark):
    """Two texts with one changed word share n - 9 of n + 1 shingles: from under 0.8 to over 0.85 as they grow."""
    rows = []
    for n in range(46, 80):
        w = [f"a{n}-{k}" for k in range(n)]
        rows += [(2 * n, " ".join(w)), (2 * n + 1, " ".join([*w[: n // 2], "changed", *w[n // 2 + 1 :]]))]
    sets = {i: shingles(t) for i, t in rows}
    like = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in sets if i % 2 == 0}
    assert min(like.values()) < 0.8 and any(0.8 <= x < 0.85 for x in like.values()) and max(like.values()) > 0.85
    kept = {r.doc_id for r in corpus_pipeline.neardup_stage(spark, docs(spark, rows), SF).collect()}
    assert kept == set(sets) - {i + 1 for i, x in like.items() if x >= 0.8}


# ------------------------------------------------------------------ licenses
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
LICENSES = [
    ("licensed under the MIT License", "MIT"),
    ("Licensed under the Apache License 2.0", "Apache-2.0"),
    ("This file is under the GNU General Public License v3.0 or so", "GPL-3.0"),
    (GNU.format("General Public License", "3"), "GPL-3.0"),
    (GNU.format("General Public License", "2"), "GPL-2.0"),
    (GNU.format("General Public License", "9"), ""),
    (GNU.format("Lesser General Public License", "3"), "LGPL-3.0"),
    (GNU.format("Affero General Public License", "3"), "AGPL-3.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
    ("CC BY-SA 4.0", "CC-BY-SA-4.0"),
    ("SPDX-License-Identifier: EPL-2.0", "EPL-2.0"),
    ("Released under the MIT License or the Apache License, Version 2.0, as you like", "Apache-2.0,MIT"),
    ("we went under the bridge and licensed nothing", ""),
]


def test_license_wordings_and_siblings(spark):
    fill = "some words stand here before any notice does " * 3
    rows = [(i, fill + t + " " + fill) for i, (t, _) in enumerate(LICENSES)]
    got = {r.doc_id: r.licenses for r in license.report(docs(spark, rows)).collect()}
    assert got == {i: x for i, (_, x) in enumerate(LICENSES)}


# ------------------------------------------------------------------ queries over whole tables
@pytest.mark.parametrize("name", ["tsql_cast_rounding_all", "sql_names_all", "tsql_not_in_null_all"])
def test_whole_tables(spark, name):
    c = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    if name != "tsql_not_in_null_all":
        table = "lineitem" if "cast" in name else "orders"
        assert len(got) == c.sql(f"SELECT count(*) FROM {table}").fetchall()[0][0]
