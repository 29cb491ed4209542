"""Every registered query that SQL can express against DuckDB, and the contract of the entry module."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from barloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def cells(frame):
    def one(v):
        if pd.isna(v):
            return "-"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    own = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(one(v) for v in row) for row in own.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, sf, db, name):
    want, got = db.execute(catalogue.ORACLES[name]).df(), catalogue.QUERIES[name](spark, sf).toPandas()
    assert sorted(want.columns) == sorted(got.columns) and len(want) == len(got)
    assert cells(want) == cells(got), [x for x in zip(cells(want), cells(got)) if x[0] != x[1]][:3]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf, name):
    """Seeded, learned and unit-root queries: the same rows twice."""
    first, again = (sorted(map(str, catalogue.QUERIES[name](spark, sf).collect())) for _ in range(2))
    assert first == again


def test_plans_keep_filters_and_columns_at_the_scan(spark, sf):
    plan = catalogue.cross_signal(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double" in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_imports_without_the_corpus_operators(tmp_path):
    """The library and its queries stand without the llm folders and the pipeline."""
    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name.startswith('barloom.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone()); sys.path.insert(0, {str(root)!r})
import __spark_entry__ as e
print(len(e.queries()), 'pipeline' in e.queries(), any(n.startswith('op') for n in e.queries()))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path)
    assert out.stdout.split()[1:] == ["False", "False"], out.stderr
