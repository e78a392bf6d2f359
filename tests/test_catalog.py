"""Queries against their SQL on the smallest tables. Loops are held against plain Python in test_fixtures.py; here only some."""

import math
import os

import duckdb
import pytest

from graphloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
#: The driver of the project runs all; these cover each part.
NAMES = "q_exact_list q_bad_bound update_property remove_property_after_merge graphson_round_trip coercion v_by_ids e_between v_value_map q_exact_multi q_complex q_by_meta adj_vertices_both degree_out graph_property_stats batches merge_generate_new_id".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sql, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = sql.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == want


def explained(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_look_ups_reach_the_scan(spark):
    plan = explained(catalog.queries()["v_by_ids"](spark, SF))
    assert "EqualTo(c_custkey,1)" in plan and "EqualTo(p_partkey,7)" in plan and plan.count("FileScan") == 2
    plan = explained(catalog.queries()["e_between"](spark, SF))
    assert "EqualTo(n_nationkey,3)" in plan and plan.count("FileScan") == 1
    plan = explained(catalog.queries()["e_by_property"](spark, SF))
    assert plan.count("EqualTo(l_quantity,17.0)") == 2 and "Window" not in plan and "Exchange" not in plan


def test_all_have_sql():
    assert set(catalog.oracle_sql()) == set(catalog.queries())


def test_filters_reach_the_scan(spark):
    plan = catalog.queries()["v_by_property"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)]" in plan and plan.count("FileScan") == 1
    assert "struct<c_custkey:bigint,c_mktsegment:string>" in plan
