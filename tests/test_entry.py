"""The driver contract, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tallgrass import catalogue

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


def test_without_training_data(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op1_')]; assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})


@pytest.mark.parametrize("name", ["flagship", "where_ne_str_ci", "or_chain_binding", "between_mixed_sign", "intersect_large", "order_string_ci", "stat_total", "group_all", "search_punctuation", "write_increment", "evolve_default_on_read", "sharded_group", "queue_drain"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for n in ("nation", "customer", "supplier", "part", "orders", "lineitem", "documents"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{DATA}/{n}.parquet'")
    df = catalogue.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in names)} FROM ({catalogue.SQL[name]})").fetchall()
    plain = lambda rows: sorted((tuple(float(x) if isinstance(x, (int, float)) else x for x in r) for r in rows), key=repr)
    assert plain(tuple(r) for r in df.select(*names).collect()) == plain(want)
