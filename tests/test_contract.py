"""The queries of the graph engine against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomgraph import queries

SF = "/root/testdata/sf0.001"
#: Slow or SQL-free queries are covered by tests of their own; box_memb etc. by test_boxcover.
PICKED = [n for n in queries.oracle_sql() if n.startswith(("derive_", "graph_", "stat_", "fn_", "io_", "gen_", "centrality_degree", "centrality_edge_betweenness_merged", "path_all_pairs", "path_counts", "cc_strong_suppliers", "cc_weak", "change_", "hub_", "box_balls"))]
PICKED = [n for n in PICKED if n not in ("centrality_edge_betweenness_merged", "hub_distances_after_insertions")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if x != x else float(x) if isinstance(x, float) else x for x in r) for r in frame.astype(object).values.tolist()), key=repr)


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "degree", "triangles", "open_wedges", "score"]
    assert df.count() == 200


@pytest.mark.parametrize("name", PICKED)
def test_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
