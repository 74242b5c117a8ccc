"""Every registered graph query against its SQL on the smallest tables, and the entry points without the optional operators."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from weftgraph.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: repr(round(v, 8)) if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, sf, db, name):
    df = catalogue.queries()[name](spark, sf)
    want = db.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_optional_operators(tmp_path):
    """A copy without the training-data operators imports and keeps the other queries."""
    import shutil

    shutil.copytree(os.path.join(REPO, "weftgraph"), tmp_path / "weftgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(REPO, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_regex' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_with_a_missing_dependency(tmp_path):
    """Where what the training-data operators depend on is missing, they alone are left out."""
    import shutil

    shutil.copytree(os.path.join(REPO, "weftgraph"), tmp_path / "weftgraph", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(REPO, name)):
            shutil.copy(os.path.join(REPO, name), tmp_path)
    (tmp_path / "public_tokenizers.py").write_text("raise ModuleNotFoundError('gone', name='public_tokenizers')")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_regex' in q and 'pipeline' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_tables_are_shared_and_forgotten(spark):
    from types import SimpleNamespace

    from weftgraph.plans.lineage import forget, shared_dir, written

    first = written(spark.range(10))
    path = first._weftgraph_path.removeprefix("file://")
    second = written(first.filter("id > 4"), first)
    assert second.count() == 5 and not os.path.exists(path)
    forget(second)
    forget(spark.range(1))
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://one:7077"))
    with pytest.raises(RuntimeError):
        shared_dir(cluster)
