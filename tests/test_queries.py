"""Every query that has SQL gives the rows that DuckDB gives on the same small tables."""

import os

import duckdb
import pytest

from topicgrove.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = db.sql(SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == rows
    spark.catalog.clearCache()


def test_entry_module_lives_without_the_corpus_package(tmp_path):
    """A copy without the corpus operators and their pipeline still imports and offers the other queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/topicgrove", tmp_path / "topicgrove", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(k.startswith('op') or k == 'pipeline' for k in q); print(len(q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split() == [str(len(QUERIES)), str(len(SQL))], out.stderr
