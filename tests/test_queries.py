"""Registered queries against their SQL, and invariants of those without one."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from tallymark.learning import grid
from tests.conftest import SF

TABLES = "documents embeddings pages labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    found = entry_points.queries()[name](spark, SF)
    cursor = duck.execute(entry_points.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert table(found.columns, [tuple(r) for r in found.collect()]) == table(columns, cursor.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 4


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_kcentre_query(spark):
    rows = entry_points.queries()["kcentre_sample"](spark, SF).groupBy("label").count().collect()
    assert len(rows) == 10 and all(r["count"] <= 20 for r in rows)


@pytest.mark.parametrize("name", ["cluster_kmeans", "cluster_hierarchical", "cluster_spectral"])
def test_cluster_queries_keep_all_rows(spark, name):
    rows = entry_points.queries()[name](spark, SF).collect()
    assert sum(r["rows"] for r in rows) == 500


def test_hashed_vector_query(spark):
    rows = entry_points.queries()["hashed_vectors"](spark, SF).collect()
    assert len(rows) == 200 and all(r.norm == pytest.approx(1, abs=1e-3) for r in rows)


def test_learning_queries_do_the_whole_job(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(grid, "score_candidates", lambda df, found, **how: asked.setdefault(how["vector"], []).append((df, found, how.get("seeds", (0,)))) or [])
    entry_points.queries()["grid_search"](spark, SF)
    found = asked.pop("embedding")[0][1]
    assert len(found) == 68 and found == [c for c in grid.candidates() if c[2] <= 64]
    entry_points.queries()["repeated_cv"](spark, SF)
    assert [len(set(seeds)) for _, _, seeds in asked.pop("embedding")] == [10]
    entry_points.queries()["compare_embeddings"](spark, SF)
    assert {vector: [len(set(seeds)) for _, _, seeds in runs] for vector, runs in asked.items()} == {"embedding": [10], "hashed": [10]}
    row = asked["hashed"][0][0].first()
    assert len(row.hashed) == len(row.embedding) == 64 and row.hashed != row.embedding
    assert entry_points.queries()["project_vectors"](spark, SF).count() == 64
