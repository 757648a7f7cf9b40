"""Registered queries of the text operators against their SQL, and the columns that are agreed."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_points
from tallymark.llm import queries
from tests.conftest import SF
from tests.test_queries import table

COLUMNS = {
    "op1_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op2_toxicity": "doc_id held_out score predicted",
    "op3_repetition": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_jaccard": "doc_id n_shingles component_id",
    "op6_page_text": "page_id url text n_chars",
    "op7_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op8_topk": "query_id rank vec_id score",
    "op11_centroids": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op12_near_dedup": "doc_id n_shingles component_id kept",
    "op13_collocations": "lang rank phrase a l r n score",
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for source in ("documents", "embeddings", "pages"):
        duck.execute(f"CREATE VIEW {source} AS SELECT * FROM '{SF}/{source}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert table(found.columns, [tuple(r) for r in found.collect()]) == table(columns, cursor.fetchall())


def test_one_query_for_each_operator():
    names = [n for n in entry_points.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and "pipeline" in entry_points.queries()


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_agreed_columns_come_first(spark, name):
    found = queries.QUERIES[name](spark, SF)
    wanted = COLUMNS[name].split()
    assert set(wanted) <= set(found.columns)
    if name in ("op8_topk", "op13_collocations"):
        return
    source = {"op6_page_text": "pages", "op11_centroids": "embeddings"}.get(name, "documents")
    assert found.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()


AWAY = """
import importlib.util, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.shuffle.partitions", "4").getOrCreate()
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry_points
seen = spark.range(1).mapInArrow(lambda batches: (b for b in batches if importlib.util.find_spec("tallymark") is None), "id long").count()
assert seen == 1, "workers see the package"
for name, query in entry_points.queries().items():
    if name.startswith("op"):
        assert query(spark, sys.argv[2]).count() > 0, name
        print(name)
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    repo = os.path.dirname(os.path.abspath(entry_points.__file__))
    script = tmp_path / "away.py"
    script.write_text(AWAY)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, str(script), repo, SF], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    assert len(run.stdout.split()) == 13
