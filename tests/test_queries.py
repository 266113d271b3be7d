"""Every registered query with SQL against DuckDB at the smallest scale, and the entry from elsewhere."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from doccat.plans.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
ROOT = str(Path(entry.__file__).parent)


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_sql(spark, duck, name):
    assert compare(spark, duck, SF_DIR, QUERIES[name], ORACLES[name]) is None


def test_entry_and_registry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(ORACLES) == set(QUERIES) - {"kmeans_fit"}
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def run_elsewhere(code: str, folder) -> str:
    """Run ``code`` with the repository on its own path only, from another folder."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", f"import sys; sys.path.insert(0, {ROOT!r})\n{code}"],
        cwd=folder, env=env, capture_output=True, text=True, timeout=600,
    )
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout


def test_entry_imports_without_any_jar(tmp_path):
    code = f"""
import pathlib, pyspark
pyspark.__file__ = {str(tmp_path / "pyspark" / "__init__.py")!r}
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()))"""
    many, with_sql = map(int, run_elsewhere(code, tmp_path).split())
    assert many >= len(QUERIES) and with_sql >= len(ORACLES)


def test_executors_get_the_package(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
conf = {{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": {str(tmp_path)!r}}}
spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
import __spark_entry__ as e
print("rows", e.entry(spark).count(), e.queries()["intra_cluster"](spark, {SF_DIR!r}).count())"""
    out = run_elsewhere(code, tmp_path)
    assert out.split()[-3] == "rows" and int(out.split()[-2]) > 100


SEARCHES = "job_similar job_similar_report similar_ranked similar_report similar_topk similar_topk_pruned skos_similar".split()


def test_searches_and_pairs_are_whole(spark, tmp_path):
    """Every document is looked up, whatever its id, and every two different vectors that share a term are listed."""
    rows = [(1, "zone zone foret"), (2, "zone route"), (3, "route pont pont"), (7, "zone route"), (49, "seul")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("similar_topk", "similar_ranked"):
        assert {r["doc_id"] for r in QUERIES[name](spark, str(tmp_path)).collect()} == {1, 2, 3, 7}
    found = {(r["a"], r["b"], r["n_a"], r["n_b"]): r["cosine"] for r in QUERIES["cosine_pairs"](spark, str(tmp_path)).collect()}
    assert set(found) == {(1, 2, 1, 2), (2, 3, 2, 1)} and all(0 < c < 1 for c in found.values())
    assert not [name for name in SEARCHES if "%" in ORACLES[name].replace("%Y", "")]
