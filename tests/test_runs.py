"""Summaries of runs on tables that the driver's smallest ones don't show."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import stats as T
from barloom.plans import catalogue

from .test_catalogue import cells


def test_run_summary_without_a_losing_day(spark, sf, tmp_path):
    """One label only gains, the other never moves."""
    tax = F.when(F.col("l_linestatus") == "F", F.col("l_discount") / 2 - 0.001).otherwise(F.col("l_discount"))
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").limit(500).withColumn("l_tax", tax)
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    db.register("lineitem", rows.toPandas())
    want, got = db.execute(catalogue.ORACLES["run_summary"]).df(), catalogue.run_summary(spark, str(tmp_path)).toPandas()
    assert cells(want[want.label == "F"]) == cells(got[got.label == "F"]) and sorted(map(str, got.sortino)) == ["inf", "nan"]
    rest = ["psr", "dsr"]  # of a run that never moves the SQL says 1, as DuckDB's NaN is above all numbers
    assert cells(want.drop(columns=rest)) == cells(got.drop(columns=rest))


def test_trades_that_tie_share_their_equity(spark):
    rows = spark.createDataFrame([("a", 1, "p", 5.0), ("a", 1, "p", -7.0), ("a", 2, "p", 1.0)], "label string, exit_ts long, pair string, net_pnl double")
    found = T.running_equity(rows, ("label",), 100.0)
    assert [r.equity for r in found.orderBy("exit_ts").collect()] == [98.0, 98.0, 99.0]
    assert T.drawdowns(found, ("label",), ("exit_ts", "pair"), start=100.0).first().max_drawdown == pytest.approx(0.02)


def test_intervals_of_large_groups_are_drawn_by_slices(spark, monkeypatch):
    """No task holds a large group: what its slices give has the mean and the spread of draws from all of it."""
    r = np.random.default_rng(5)
    own = {"few": r.integers(0, 9, 3000) / 100, "many": r.normal(0.01, 0.03, 3000), "small": r.normal(0, 1, 40), "none": np.array([None])}
    rows = spark.createDataFrame([(k, i, None if v is None else float(v)) for k, x in own.items() for i, v in enumerate(x)], "label string, exit_ts long, ret double")
    plain = {x.label: x for x in T.bootstrap_mean(rows, ("label",), n_boot=3000).collect()}
    monkeypatch.setattr(T, "RESAMPLED", 100)
    first, again = ({x.label: x for x in T.bootstrap_mean(rows, ("label",), n_boot=3000).collect()} for _ in range(2))
    assert first == again and set(first) == set(own)
    assert first["small"] == plain["small"] and first["none"][1:] == (0.0, 0.0, 0.0)
    for k in ("few", "many"):
        width = 2 * 1.96 * own[k].std() / 3000**0.5
        assert first[k].mean == pytest.approx(own[k].mean()) and first[k].upper - first[k].lower == pytest.approx(width, rel=0.1)
        assert first[k].lower == pytest.approx(plain[k].lower, abs=0.1 * width) and first[k] != plain[k]


def test_runs_cut_into_time_slices(spark):
    """The peak and the sum are carried from slice to slice; a missing time comes first."""
    r = np.random.default_rng(6)
    rows = [(k, None if i < 3 else int(t), str(i), float(v)) for k in ("a", None) for i, (t, v) in enumerate(zip(r.integers(-500, 500, 300), r.normal(0, 1, 300)))]
    trades = spark.createDataFrame(rows, "label string, exit_ts long, pair string, net_pnl double")
    found = [T.running_equity(trades, ("label",), 100.0, slice_ms=n) for n in (None, 50)]
    whole, cut = (sorted((str(x.label), x.pair, round(x.equity, 9)) for x in f.collect()) for f in found)
    assert whole == cut and len(whole) == 600
    falls = [sorted(round(x.max_drawdown, 9) for x in T.drawdowns(found[0], ("label",), ("exit_ts", "pair"), start=100.0, slice_ms=n).collect()) for n in (None, 50)]
    assert falls[0] == falls[1] and len(falls[0]) == 2
