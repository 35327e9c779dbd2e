"""Every query of the catalogue against its SQL on the smallest data, or for its invariants."""

import duckdb
import pytest

from compare import TABLES, rows
from livgrid.plans import catalogue


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf, db, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), db.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_zone_invariants(spark, sf):
    for r in catalogue.QUERIES["zone_stats"](spark, sf).collect():
        alone = [r[c] for c in r.asDict() if c.startswith("c_")]
        assert r["ok"] <= min(alone) <= r["total"]


def test_weighted_paths_equal_a_heap_search(spark, sf):
    a = {tuple(r) for r in catalogue.QUERIES["shortest_path_weighted"](spark, sf).collect()}
    groups = catalogue.QUERIES["shortest_path_grouped"](spark, sf).collect()
    assert a == {tuple(r)[1:] for r in groups if r["g"] == 0} and {r["source"] for r in groups if r["g"] == 2} == {2}


def test_profiles_cover_every_day(spark, sf):
    from livgrid.plans import timetables

    got = catalogue.QUERIES["csa_profile"](spark, sf).toPandas()
    c = timetables._connections(spark, sf).toPandas()
    # a ride straight to the destination is a way there, so some listed departure is as late and arrives as early
    for dest in ("purchase", "view"):
        direct = c[c.to_stop == dest]
        assert direct.dep.max() - direct.dep.min() > 2 * timetables.DAY
        for stop, dep, arr in direct[["from_stop", "dep", "arr"]].itertuples(index=False):
            assert ((got.dest == dest) & (got.stop == stop) & (got.dep >= dep) & (got.arr <= arr)).any()


def test_plans_push_down_and_prune(spark, sf):
    plan = catalogue.QUERIES["zone_stats"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "FileScan parquet" in x and "l_partkey" in x)
    assert "IsNotNull(l_suppkey)" in scan and "l_shipdate" not in scan
