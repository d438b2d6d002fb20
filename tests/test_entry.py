"""Registration: the flagship query, the SQL's names, and the library without its optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from facetline import plans

ROOT, SF = Path(__file__).resolve().parent.parent, "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_flagship(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["id", "callers", "external_callers", "fan_out", "tested", "test_callers"] and rows.count() > 0


def test_sql_belongs_to_queries():
    assert plans.oracle_sql().keys() <= plans.queries().keys()
    assert plans.queries().keys() - plans.oracle_sql().keys() == {"sl3_neighborhood_capped", "sl5_overview_capped", "gr5_core_clusters", "e2_review_plan"}


@pytest.mark.parametrize("name", ["ag3_edge_merge", "ag2_lines_per_symbol", "jn4_reconcile", "gr11_resolve_calls", "ag13_facets", "tf17_diff_lines"])
def test_rows_equal_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(plans.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    want = sorted(str(r) for r in found.fetchall())
    got = plans.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == want


def test_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin"})
    assert out.stdout.split() == [str(len(plans.queries())), "False"]
