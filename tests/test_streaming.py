"""Streams against the batch engine and against hand-computed updates."""


from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.costs import CostModel, log_spread
from barloom.operators import bars as B
from barloom.operators import features as X
from barloom.operators import portfolio as PF
from barloom.operators import simulate as S
from barloom.sources import synthetic
from barloom.streaming import candles as SC
from barloom.streaming import engine as SE

M, DAY = 60_000, 86_400_000


def candle(ts, close, taker=0.5):
    return (ts, close, close, close, close, 1.0, taker)


def table(rows):
    return pd.DataFrame(rows, columns=SC._CELLS)


def test_closed_candles():
    final, still_open = SC.final_candles(table([candle(ts, c) for ts, c in ((0, 10), (0, 11), (0, 12), (M, 13), (M, 14), (0, 99), (2 * M, 15))]))
    assert final.close.tolist() == [12, 14] and still_open.close.tolist() == [15]


def test_minute_bars():
    bars, rest, told = SC.complete_bars(table([candle(k * M, k) for k in (0, 1, 2, 3, 4, 3, 5, 6, 7, 8, 9, 10)]), 5 * M, -1)
    assert list(zip(bars.ts_ms, bars.n_minutes)) == [(0, 5), (5 * M, 5)] and bars.taker_buy_volume[0] == 2.5
    assert rest.ts_ms.tolist() == [10 * M] and told == 5 * M
    bars, _, _ = SC.complete_bars(table([candle(0, 1.0), candle(2 * M, 5.0, np.nan), candle(4 * M, 3.0)]), 5 * M, -1)
    assert bars[["open", "high", "low", "close", "volume", "n_minutes"]].to_numpy().tolist() == [[1, 5, 1, 3, 3, 3]] and np.isnan(bars.taker_buy_volume[0])
    bars, rest, told = SC.complete_bars(table([candle(k * M, 1) for k in (0, 7, 9)]), 5 * M, -1)
    assert bars.ts_ms.tolist() == [5 * M] and rest.empty
    assert SC.complete_bars(table([candle(4 * M, 1), candle(11 * M, 1)]), 5 * M, 5 * M)[1].ts_ms.tolist() == [11 * M]


def feed(spark, path, frames, make, out):
    """Run a stream over files that arrive one after the other, restarting it in between."""
    for k, f in enumerate(frames):
        f.to_parquet(f"{path}/in/{k:03}.parquet", index=False)
        rows = spark.readStream.schema(spark.createDataFrame(frames[0]).schema).parquet(f"{path}/in")
        stream = make(rows)
        stream.writeStream.format("parquet").option("path", f"{path}/{out}").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/{out}")


def test_candle_streams_keep_state_over_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("A", k * M, 1.0 * k, 1.0 * k, 1.0 * k, 1.0 * k, 1.0, 0.5) for k in range(12)]
    frames = [pd.DataFrame(rows[a:b], columns=["symbol", *SC._CELLS]) for a, b in ((0, 3), (3, 7), (5, 12))]
    out = feed(spark, tmp_path, frames, lambda r: SC.minute_bars(r, 5), "bars").orderBy("ts_ms").collect()
    assert [(r.ts_ms, r.open, r.close, r.n_minutes) for r in out] == [(0, 0, 4, 5), (5 * M, 5, 9, 5)]


@pytest.fixture(scope="module")
def pair_rows(spark):
    bars = B.resample(synthetic.cointegrated(spark, 60 * 24 * 8, 1), 15)
    pairs = spark.createDataFrame([("P0", "P0A/USDT", "P0B/USDT", 0.3, 1.0)], "pair string, asset1 string, asset2 string, alpha double, beta double")
    return B.align(bars, pairs, ("alpha", "beta"))


def batch_decisions(rows, window, rules):
    made = rows.withColumn("spread", log_spread("close1", "close2", "alpha", "beta")).withColumn("z", X.zscore("spread", ["pair"], "ts_ms", window))
    made = made.withColumn("signal", X.crossing("z", ["pair"], "ts_ms", 1.5))
    ts = [r.ts_ms for r in made.orderBy("ts_ms").collect()]
    out = []
    for t in S.simulate(made, rules).orderBy("entry_ts").collect():
        out.append((ts[t.signal_idx], "enter", t.side, None))
        reason = t.exit_reason.removesuffix("_at_window_end")
        if reason in S.REASONS:  # decided on the bar before the fill, or on the last bar
            out.append((ts[t.exit_idx - (reason == t.exit_reason)], "exit", t.side, reason))
    return out


def test_live_decisions_are_the_batch_decisions(spark, pair_rows, tmp_path):
    rules = S.ExitRules(exit_z=0.3, stop_z=3.0, max_hold_bars=20, stop_loss=0.02)
    want = batch_decisions(pair_rows, 48, rules)
    (tmp_path / "in").mkdir()
    pdf = pair_rows.select("pair", "ts_ms", "open1", "open2", "close1", "close2", "alpha", "beta").orderBy("ts_ms").toPandas()
    cuts = [0, 100, 101, 400, len(pdf)]
    frames = [pdf.iloc[max(0, a - 2) : b] for a, b in zip(cuts, cuts[1:])]  # the last rows arrive again
    out = feed(spark, tmp_path, frames, lambda r: SE.pair_decisions(r, SE.LiveConfig(48, 1.5, rules)), "out").orderBy("ts_ms").collect()
    assert len(want) > 10 and [(r.ts_ms, r.action, r.side, r.reason) for r in out] == want


def test_streams_do_not_depend_on_arrow_batches(spark, sf):
    from barloom.plans import catalogue

    found = []
    for n in ("100", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        found.append([sorted(map(tuple, catalogue.QUERIES[q](spark, sf).collect())) for q in ("stream_minute_bars", "stream_pair_decisions", "stream_closed_candles")])
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and all(found[0])


def test_streams_start_from_history(spark, pair_rows, tmp_path):
    """A history as initial state, then the rest: the decisions of the whole."""
    rules = S.ExitRules(exit_z=0.3, stop_z=3.0, max_hold_bars=20)
    rows = pair_rows.select("pair", "ts_ms", "open1", "open2", "close1", "close2", "alpha", "beta")
    want = batch_decisions(pair_rows, 48, rules)
    ts = sorted(r.ts_ms for r in rows.collect())
    cfg = SE.LiveConfig(48, 1.5, rules)
    entries = [(k, d) for k, d in enumerate(want) if d[1] == "enter"]
    k, (at, _, side, _) = entries[3]  # the stream begins two bars into this trade
    cut = ts[ts.index(at) + 2]
    bar = rows.where(F.col("ts_ms") == ts[ts.index(at) + 1]).first()
    history = rows.where(F.col("ts_ms") <= cut)
    z = history.withColumn("spread", log_spread("close1", "close2", "alpha", "beta")).withColumn("z", X.zscore("spread", ["pair"], "ts_ms", 48)).where(F.col("ts_ms") == at).first().z
    opened = spark.createDataFrame([(bar.pair, side, z, at + 15 * M, bar.open1, bar.open2)], "pair string, side int, entry_z double, entry_ts long, open1 double, open2 double")
    warm = SE.warm_pairs(history, cfg, 15 * M, opened)
    assert warm.first().held == 2
    (tmp_path / "in").mkdir()
    pdf = rows.where(F.col("ts_ms") > cut).orderBy("ts_ms").toPandas()
    out = feed(spark, tmp_path, [pdf.iloc[:50], pdf.iloc[50:]], lambda r: SE.pair_decisions(r, cfg, warm), "out").orderBy("ts_ms").collect()
    assert [(r.ts_ms, r.action, r.side, r.reason) for r in out] == want[k + 1 :]
    none = SE.LiveConfig(48, 1.5, rules, entries_until=0)
    other = tmp_path / "none"
    (other / "in").mkdir(parents=True)
    assert feed(spark, other, [pdf], lambda r: SE.pair_decisions(r, none), "out").count() == 0
    minutes = [("A", j * M, *[float(j)] * 4, 1.0, 0.5) for j in range(17)]
    third = tmp_path / "third"
    (third / "in").mkdir(parents=True)
    frames = [pd.DataFrame(minutes[a:b], columns=["symbol", *SC._CELLS]) for a, b in ((7, 9), (9, 17))]
    warm = SC.open_minutes(spark.createDataFrame(pd.DataFrame(minutes[:7], columns=["symbol", *SC._CELLS])), 5)
    out = feed(spark, third, frames, lambda r: SC.minute_bars(r, 5, warm), "bars").orderBy("ts_ms").collect()
    assert [(r.ts_ms, r.open, r.close, r.n_minutes) for r in out] == [(5 * M, 5, 9, 5), (10 * M, 10, 14, 5)]


def test_model_decisions_do_not_depend_on_micro_batches(spark, pair_rows, tmp_path):
    """Bars in one batch and bar by bar in four, with a late BTC bar: the same decisions, none on a bar that waits."""
    from barloom.streaming.models import ModelStream

    rows = pair_rows.select("pair", "ts_ms", *[f"{c}{n}" for n in (1, 2) for c in ("open", "high", "low", "close", "volume", "taker_buy_volume")], "alpha", "beta", F.col("close2").alias("btc_close"))
    ts = sorted(r.ts_ms for r in rows.select("ts_ms").collect())
    score = lambda f: f.withColumns({"pred_ret": -F.col("z_24h") / 100, "unc": F.lit(0.001)})
    make = lambda name: ModelStream(f"{tmp_path}/{name}", SE.LiveConfig(96, 1.2, S.ExitRules(exit_z=0.3, max_hold_bars=20)), score, 15, need=0.012, adf=False)
    whole, parts = make("whole"), make("parts")
    whole(rows, 0)
    cuts = [0, 300, 500, 501, len(ts)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        own = rows.where(F.col("ts_ms").between(ts[max(0, a - 2)], ts[b - 1]))
        if k == 1:  # the newest bar comes without BTC's, and with it in the next batch
            own = own.withColumn("btc_close", F.when(F.col("ts_ms") < ts[b - 1], F.col("btc_close")))
        parts(own, k)
        if k == 1:
            assert spark.read.parquet(f"{tmp_path}/parts/batch=1/positions").first().last_ts == ts[b - 2]
        if k == 2:
            parts(own, k)  # a batch that is repeated
    of = lambda m: sorted(tuple(r) for r in m.decisions(spark).select("pair", "ts_ms", "action", "side", "reason", "held").collect())
    assert len(of(whole)) > 4 and [x for x in of(parts)] == of(whole)


def test_flush_keeps_the_last_row_of_a_key(spark, tmp_path):
    path = f"{tmp_path}/bars"
    one = spark.createDataFrame([("A", 0, 1.0), ("A", DAY, 1.0), ("B", 0, 1.0)], "symbol string, ts_ms long, close double")
    two = spark.createDataFrame([("A", 0, 2.0), ("A", M, 2.0)], "symbol string, ts_ms long, close double")
    for k, f in ((0, one), (1, two), (1, two)):
        SE.flush_keep_last(f, k, path)
    assert sorted((r.symbol, r.ts_ms, r.close) for r in spark.read.parquet(path).collect()) == [("A", 0, 2.0), ("A", M, 2.0), ("A", DAY, 1.0), ("B", 0, 1.0)]


def test_book_price(spark):
    levels = F.array(*[F.struct(F.lit(p).alias("price"), F.lit(q).alias("qty")) for p, q in ((10.0, 1.0), (10.5, 2.0))])
    row = spark.range(1).select(SE.book_price(levels, F.lit(20.5)).alias("a"), SE.book_price(levels, F.lit(1000.0)).alias("b")).first()
    assert row.a == pytest.approx(20.5 / 2) and row.b is None


def test_paper_account_and_its_stream(spark, tmp_path):
    cfg, costs = PF.PortfolioConfig(1000.0, 0.25, 2, 1.0), CostModel()
    order = lambda action, p1: SimpleNamespace(pair="P", action=action, side=1, beta=1.0, p1=p1, p2=50.0, funding=0.1)
    desk, a = SE.Desk(cfg, costs), SE.Account(1000.0)
    a, _ = desk.apply(a, order("enter", 100.0))
    assert desk.room(a, "P") == 0 and desk.room(a, "Q") == 250
    assert desk.apply(a, order("exit", np.nan)) == (a, None)
    a, done = desk.apply(a, order("exit", 101.0))
    assert done["gross_pnl"] == pytest.approx(1.25) and done["fees"] == pytest.approx(0.0005 * (250 + 126.25 + 125))
    (tmp_path / "in").mkdir()
    rows = [("acc", "P", 1, "enter", 1, 1.0, 100.0, 50.0, 0.0), ("acc", "Q", 2, "enter", 1, 1.0, np.nan, 50.0, 0.0), ("acc", "P", 3, "exit", 1, 1.0, np.nan, 50.0, 0.0), ("acc", "P", 4, "exit", 1, 1.0, 101.0, 50.0, 0.1)]
    frames = [pd.DataFrame([r], columns=["account", "pair", "ts_ms", "action", "side", "beta", "p1", "p2", "funding"]) for r in rows]
    out = feed(spark, tmp_path, frames, lambda r: SE.paper_account(r, cfg, costs), "fills").orderBy("ts_ms").collect()
    assert [(r.ts_ms, r.action) for r in out] == [(1, "enter"), (4, "exit")] and out[1].equity_after == pytest.approx(a.equity)
    assert [r.ts_ms for r in SE.recent_trades(spark.read.parquet(f"{tmp_path}/fills"), 1).collect()] == [4]


def test_repeated_batches_are_not_doubled(spark, tmp_path):
    rows = spark.range(3)
    for _ in range(2):
        SE.append_once(rows, 7, f"{tmp_path}/sink")
    assert spark.read.parquet(f"{tmp_path}/sink").count() == 3


def test_windowed_bars_and_leg_joins(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("A", k * M, 1.0 * k, 1.0 * k, 1.0 * k, 1.0 * k, 1.0, 0.5) for k in range(60)]
    out = feed(spark, tmp_path, [pd.DataFrame(rows, columns=["symbol", *SC._CELLS]), pd.DataFrame([("A", 90 * M, *[1.0] * 6)], columns=["symbol", *SC._CELLS])], lambda r: SC.windowed_bars(r, 15), "w")
    assert {(r.ts_ms, r.close) for r in out.collect()} >= {(0, 14.0), (15 * M, 29.0)}
    legs = [pd.DataFrame({"pair": "P", "ts_ms": [60 * M, 61 * M], "open": 1.0, "high": 1.0, "low": 1.0, "close": [1.0, 2.0], "volume": 1.0})]
    other = tmp_path / "other"
    (other / "in").mkdir(parents=True)
    joined = feed(spark, other, legs, lambda r: SC.join_legs(r, r), "j")
    assert {(r.ts_ms, r.close1, r.close2) for r in joined.collect()} == {(60 * M, 1.0, 1.0), (61 * M, 2.0, 2.0)}
