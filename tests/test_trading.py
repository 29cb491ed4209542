"""Hand-computed cases of costs, simulation, portfolio and the daily backtest."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.costs import CostModel
from barloom.operators import daily as D
from barloom.operators import funding as FU
from barloom.operators import panel as N
from barloom.operators import portfolio as PF
from barloom.operators import simulate as S

DAY = 86_400_000


def one(spark, **columns):
    return spark.range(1).select(*[(v if not isinstance(v, (int, float)) else F.lit(v)).alias(k) for k, v in columns.items()]).first()


def test_costs(spark):
    c = CostModel()
    assert abs(c.round_trip_rate - 0.0013) < 1e-15
    row = one(spark, taker=c.fill_cost(F.lit(1000.0)), maker=c.fill_cost(F.lit(1000.0), F.lit(1e6), F.lit(True)), impact=c.impact_rate(F.lit(100.0), F.lit(10_000.0)), free=c.impact_rate(F.lit(100.0), F.lit(0.0)))
    assert row.taker == pytest.approx(0.65) and row.maker == pytest.approx(0.2) and row.impact == pytest.approx(1e-4) and row.free == 0
    for maker in (None, True, False):
        own = c.fill_cost(F.lit(500.0), F.lit(1e5), None if maker is None else F.lit(maker))
        assert one(spark, x=own).x == pytest.approx(c.fill_cost_value(500.0, 1e5, maker))
    assert CostModel(multiplier=2).default_rate == 2 * c.default_rate


def test_funding_windows(spark):
    events = spark.createDataFrame([("A", 10, 1e-4), ("A", 20, 2e-4), ("A", 30, -5e-4)], "symbol string, ts_ms long, funding_rate double")
    legs = spark.createDataFrame([("A", 1, 1000.0, 5, 20), ("A", 1, 1000.0, 10, 20), ("A", -1, 1000.0, 5, 30), ("B", 1, 1.0, 0, 99), ("A", 1, 1000.0, 20, 20)], "symbol string, sign int, notional double, entry_ts long, exit_ts long")
    out = {(r.symbol, r.sign, r.entry_ts): r.funding_cost for r in FU.payments(legs, events).collect()}
    assert out["A", 1, 5] == pytest.approx(0.3) and out["A", 1, 10] == pytest.approx(0.2)
    assert out["A", -1, 5] == pytest.approx(0.2) and out["B", 1, 0] == 0 and out["A", 1, 20] == 0


def bars(n=50, z=None, signal=None, price=100.0, **more):
    close = np.full(n, price) if np.isscalar(price) else np.asarray(price, float)
    z = np.zeros(n) if z is None else z
    s = np.zeros(n)
    for k, v in (signal or {}).items():
        s[k] = v
    own = {"ts": np.arange(n) * 300_000, "open1": close * 1.001, "close1": close, "open2": close * 1.001, "close2": close, "vol1": np.zeros(n), "vol2": np.zeros(n), "z": np.asarray(z, float), "signal": s}
    return S.Bars(**own | more)


def walk(b, rules=S.ExitRules(), beta=1.0, **kw):
    return S.PairWalk(b, beta, rules, **kw).run()


def test_entry_and_exit_fill_at_the_next_open():
    z = np.zeros(50)
    z[10:20] = -3
    (t,) = walk(bars(z=z, signal={10: 1}))
    assert (t["signal_idx"], t["entry_idx"], t["exit_idx"], t["exit_reason"]) == (10, 11, 21, "take_profit")
    (t,) = walk(bars(z=z, signal={10: 1}), latency=2)
    assert (t["entry_idx"], t["exit_idx"]) == (13, 23)


def test_first_event_decides_and_priority_breaks_ties():
    z = np.full(50, -3.0)
    z[14:] = -5
    (t,) = walk(bars(z=z, signal={10: 1}), S.ExitRules(max_hold_bars=30))
    assert (t["exit_reason"], t["exit_idx"]) == ("stop_z", 15)
    (t,) = walk(bars(z=z, signal={10: 1}), S.ExitRules(stop_z=1.0, stop_mode="relative"))
    assert t["exit_reason"] == "stop_z"
    (t,) = walk(bars(z=np.where(np.arange(50) > 10, np.nan, -3.0), signal={10: 1}), S.ExitRules(max_hold_bars=3))
    assert (t["exit_reason"], t["exit_idx"]) == ("time_stop", 14)
    price = np.full(50, 100.0)
    price[13:] = 90
    b = bars(z=np.full(50, -3.0), signal={10: 1}, price=price)
    b.close2 = b.open2 = np.full(50, 100.0)
    (t,) = walk(b, S.ExitRules(stop_loss=0.02))
    assert (t["exit_reason"], t["exit_idx"]) == ("stop_loss", 14)


def test_window_end():
    z = np.full(50, -3.0)
    (t,) = walk(bars(z=z, signal={10: 1}), hi=20)
    assert (t["exit_reason"], t["exit_idx"], t["exit_ts"]) == ("end_of_window", 19, 20 * 300_000)
    z[19] = 0
    (t,) = walk(bars(z=z, signal={10: 1}), hi=20)
    assert t["exit_reason"] == "take_profit_at_window_end"
    assert walk(bars(z=z, signal={19: 1}), hi=20) == []


def test_no_entry_on_the_bar_of_an_exit_decision():
    z = np.full(50, -3.0)
    z[20] = 0
    trades = walk(bars(z=z, signal={10: 1, 20: 1, 21: -1}))
    assert [t["signal_idx"] for t in trades] == [10, 21]


def maker_bars(low1=None, high2=None, n=30, **kw):
    flat = np.full(n, 100.0)
    b = bars(n, price=100.0, **kw)
    b.open1 = b.open2 = flat
    b.high1 = b.low2 = b.high2 = b.low1 = flat
    if low1:
        b.low1 = flat.copy()
        for k, v in low1.items():
            b.low1[k] = v
    if high2:
        b.high2 = flat.copy()
        for k, v in high2.items():
            b.high2[k] = v
    return b


def test_maker_fills_need_a_trade_through():
    w = S.PairWalk(maker_bars(low1={1: 100.0, 2: 99.995, 3: 99.98}), 1.0, S.ExitRules(), execution=S.Execution("maker"))
    assert w.fills[0, 0, :4].tolist() == [3, 3, 3, S._NEVER] and (w.fills[1] == S._NEVER).all() and (w.fills[0, 1] == S._NEVER).all()
    z = np.full(30, -3.0)
    both = maker_bars(low1={6: 99.9}, high2={7: 100.1}, z=z, signal={5: 1})
    (t,) = walk(both, execution=S.Execution("maker"))
    assert (t["entry_idx"], t["entry_maker1"], t["entry_maker2"], t["entry_p1"]) == (7, True, True, 100.0)
    one_leg = maker_bars(low1={6: 99.9}, z=z, signal={5: 1})
    (t,) = walk(one_leg, execution=S.Execution("maker"))
    assert (t["entry_idx"], t["entry_maker1"], t["entry_maker2"]) == (9, True, False)
    assert walk(maker_bars(z=z, signal={5: 1}), execution=S.Execution("maker")) == []


def test_an_order_in_the_book_blocks_decisions():
    z = np.full(30, -3.0)
    b = maker_bars(low1={9: 99.9}, high2={9: 100.1}, z=z, signal={5: 1, 6: 1, 8: 1})
    (t,) = walk(b, execution=S.Execution("maker"))
    assert t["signal_idx"] == 8


def test_maker_take_profit_leaves_within_the_bar():
    z = np.full(30, -3.0)
    z[12:] = 0
    b = maker_bars(low1={6: 99.9}, high2={6: 100.1}, z=z, signal={5: 1})
    b.high1 = np.full(30, 100.0)
    b.low2 = np.full(30, 100.0)
    b.high1[14], b.low2[14] = 100.1, 99.9
    (t,) = walk(b, execution=S.Execution("maker"))
    assert (t["exit_idx"], t["exit_ts"], t["exit_maker1"], t["exit_maker2"]) == (14, 15 * 300_000 - 1, True, True)


def candidates(spark, rows):
    base = {"side": 1, "w1": 0.5, "w2": 0.5, "entry_p1": 1.0, "entry_p2": 1.0, "exit_p1": 1.0, "exit_p2": 1.0, "entry_vol1_usd": 0.0, "entry_vol2_usd": 0.0, "exit_vol1_usd": 0.0, "exit_vol2_usd": 0.0, "label": "x"}
    return spark.createDataFrame(pd.DataFrame([base | {"pair": p, "entry_ts": a, "exit_ts": b, "gross_ret": r} for p, a, b, r in rows]))


FREE = CostModel(0, 0, 0, 0, 0)


def test_portfolio_sizes_from_realized_equity(spark):
    cfg = PF.PortfolioConfig(1000.0, 0.5, 2, 1.0)
    rows = [("A", 0, 10, 0.1), ("B", 1, 20, 0.0), ("C", 5, 30, 0.5), ("A", 12, 40, 0.0)]
    out = {(r.pair, r.entry_ts): r for r in PF.run_portfolio(candidates(spark, rows), FREE, cfg).collect()}
    assert out["A", 0].gross_notional == 500 and out["B", 1].gross_notional == 500
    assert not out["C", 5].accepted and out["C", 5].gross_notional is None
    assert out["A", 12].gross_notional == pytest.approx(525) and out["A", 0].equity_after == pytest.approx(1050)


def test_portfolio_refuses_open_pairs_and_by_predicate(spark):
    rows = [("A", 0, 10, 0.1), ("A", 5, 20, 0.1), ("A", 10, 30, 0.1)]
    out = {r.entry_ts: r.accepted for r in PF.run_portfolio(candidates(spark, rows), FREE).collect()}
    assert out == {0: True, 5: False, 10: True}
    none = PF.run_portfolio(candidates(spark, rows), FREE, accept=F.col("gross_ret") > 1).collect()
    assert not any(r.accepted for r in none)


def panel(spark, close, funding=None, high=None):
    close = np.asarray(close, float)
    cell = lambda m, d, s: None if m is None or not np.isfinite(m[d][s]) else float(m[d][s])
    rows = [(d, d * DAY, f"S{s}", s, cell(close, d, s), cell(funding, d, s) or 0.0, 1.0, cell(high, d, s)) for d in range(close.shape[0]) for s in range(close.shape[1])]
    return spark.createDataFrame(rows, "d_idx int, day_ms long, symbol string, s_idx int, close double, funding double, quote_volume double, high double")


def weights(spark, w, label="x"):
    return spark.createDataFrame([(label, d, f"S{s}", float(v)) for d, row in enumerate(w) for s, v in enumerate(row)], "label string, d_idx int, symbol string, w double")


def test_run_daily_by_hand(spark):
    p = panel(spark, [[100, 50], [110, 50], [110, 55]], [[0, 0], [0.001, 0], [0, 0]])
    out = D.run_daily(p, weights(spark, [[0.5, -0.5], [0.5, -0.5], [0, 0]]), costs=CostModel(0.001, 0, 0, 0)).orderBy("d_idx").collect()
    assert out[0].gross == pytest.approx(0.05) and out[0].funding == pytest.approx(0.0005) and out[0].cost == pytest.approx(0.001)
    drifted = np.array([0.55, -0.5]) / 1.05
    assert out[1].turnover == pytest.approx(np.abs(np.array([0.5, -0.5]) - drifted).sum())


def test_delisting_ruin_and_column_rates(spark):
    out = D.run_daily(panel(spark, [[100], [math.nan], [math.nan]]), weights(spark, [[1.0], [1.0], [1.0]]), costs=FREE).orderBy("d_idx").collect()
    assert [r.gross for r in out] == [0, 0] and [r.turnover for r in out] == [1, 1]
    out = D.run_daily(panel(spark, [[1], [3], [0.5], [0.5]]), weights(spark, [[-0.5]] * 4), costs=FREE).orderBy("d_idx").collect()
    assert [r.net for r in out] == [-1.0, 0.0, 0.0]
    rates = spark.createDataFrame([("S0", 0.0005), ("S1", 0.001)], "symbol string, rate double")
    out = D.run_daily(panel(spark, [[1, 1], [1, 1]]), weights(spark, [[0.5, 0.5], [0, 0]]), costs=CostModel(multiplier=2.0), rates=rates).collect()
    assert out[0].cost == pytest.approx(0.0015)


def test_drift_without_rebalance_and_interest(spark):
    p, w = panel(spark, [[1], [2], [2]]), weights(spark, [[0.5]] * 3)
    reb = spark.createDataFrame([("x", 0)], "label string, d_idx int")
    cash = spark.createDataFrame([(1, 0.01), (2, 0.01)], "d_idx int, cash_rate double")
    tied = spark.createDataFrame([("x", 0, 0.4)], "label string, d_idx int, tied double")
    out = D.run_daily(p, w, reb, FREE, cash=cash, tied=tied).orderBy("d_idx").collect()
    assert out[1].turnover == 0 and out[1].exposure == pytest.approx(1.0 / 1.5) and out[0].interest == pytest.approx(0.006)


def test_funding_belongs_to_the_day_that_ends_with_it(spark):
    events = spark.createDataFrame([("A", DAY, 0.001), ("A", DAY + 5, 0.002), ("A", 8 * 3_600_000, 0.004)], "symbol string, ts_ms long, funding_rate double")
    assert {r.day_ms: r.funding for r in FU.by_day(events).collect()} == {0: pytest.approx(0.005), DAY: 0.002}


def test_listing_events(spark):
    close = np.ones((60, 5))
    close[40:, 3] = math.nan
    days = spark.createDataFrame([("S2", 20), ("S3", 25), ("S4", 25)], "symbol string, d_idx int")
    w, events = D.listing_shorts(panel(spark, close), days, "S0", most=2)
    assert sorted((r.symbol, r.entry, r.until) for r in events.collect()) == [("S2", 21, 51), ("S3", 26, 40)]
    own = {(r.d_idx, r.symbol): r.w for r in w.collect()}
    assert own[30, "S0"] == pytest.approx(0.2) and own[30, "S2"] == pytest.approx(-0.1) and (40, "S3") not in own


def test_sized_harvest(spark):
    held = [[], [0], [0, 1], [0, 1, 2]]
    rows = [("x", d, f"S{s}", s, 10.0, True) for d, own in enumerate(held) for s in own] + [("x", 0, None, None, None, True)]
    out = D.sized_harvest(spark.createDataFrame(rows, "label string, d_idx int, symbol string, s_idx int, close double, changed boolean")).collect()
    size = {r.d_idx: (-r.w, r.tied) for r in out if r.w < 0}
    assert size == {1: (0.25, 0.5), 2: (0.25, 1.0), 3: (pytest.approx(1 / 6), pytest.approx(1.0))}
    close = [10, 12, 14.9, 15, 20, 22.6]
    rows = [("x", d, "S0", 0, float(c), d == 0) for d, c in enumerate(close)]
    out = D.sized_harvest(spark.createDataFrame(rows, "label string, d_idx int, symbol string, s_idx int, close double, changed boolean")).collect()
    assert sorted({r.d_idx for r in out if r.reb}) == [0, 3, 5]


def test_margin_breaches(spark):
    high = [[10], [15], [10], [20], [10]]
    p = panel(spark, [[10]] * 5, high=high)
    w, reb = weights(spark, [[-0.25]] * 5), spark.createDataFrame([("x", 0)], "label string, d_idx int")
    days = lambda m: sorted(r.d_idx for r in D.margin_breaches(p, w, reb, m).collect())
    assert days(1.0) == [3] and days(0.5) == [1, 3]


def test_harvest_hysteresis(spark):
    f7 = {0: [0.004, 0.004, 0.002, 0.001, 0.004], 1: [0.0, 0.005, 0.005, 0.005, 0.005]}
    rows = [("x", d, f"S{s}", s, f) for s, own in f7.items() for d, f in enumerate(own)]
    cand = spark.createDataFrame(rows, "label string, d_idx int, symbol string, s_idx int, f7 double")
    out = D.harvest(cand, 5, slots=2).collect()
    assert sorted((r.symbol, r.d_idx, r.until) for r in out if r.kind == "episode") == [("S0", 0, 3), ("S0", 4, 5), ("S1", 1, 5)]
    assert sorted(r.d_idx for r in out if r.kind == "rebalance") == [0, 1, 3, 4]
    one = D.harvest(cand, 5, slots=1).where("kind = 'episode'").collect()
    assert sorted((r.symbol, r.d_idx) for r in one) == [("S0", 0), ("S1", 3)]
    eps = D.harvest(cand, 5, slots=2).where("kind = 'episode'").select("d_idx", "until", "symbol")
    sims = D.random_episodes(eps, cand, 3)
    assert {r.sim: 0 for r in sims.collect()}.keys() == {0, 1, 2}


def test_random_entries_keep_counts_and_are_repeatable(spark):
    n = 200
    z = np.zeros(n)
    z[20:30] = -3
    rows = pd.DataFrame({"pair": "P", "ts_ms": np.arange(n) * 60_000, "z": z, "signal": np.where(np.arange(n) == 20, 1, 0), "beta": 1.0})
    price = 100 + np.cumsum(np.random.default_rng(0).normal(size=n))
    for c in ("open1", "close1", "open2", "close2"):
        rows[c] = price
    frame = spark.createDataFrame(rows)
    trades = S.simulate(frame)
    sims = S.random_entries(trades, frame, 5).select("sim", "entry_idx", "exit_idx", "side")
    got = sorted(map(tuple, sims.collect()))
    assert len(got) == 5 and {b - a for _, a, b, _ in got} == {10} and got == sorted(map(tuple, sims.collect()))


def test_panel_spine_and_spot(spark):
    daily = spark.createDataFrame([("A", 0, 1.0, 5.0), ("A", DAY, 2.0, 0.0), ("B", DAY, 3.0, 1.0)], "symbol string, ts_ms long, close double, quote_volume double")
    p = N.build_panel(daily, None, 0, 2 * DAY)
    assert {(r.d_idx, r.symbol): r.close for r in p.collect()} == {(0, "A"): 1.0, (1, "A"): None, (0, "B"): None, (1, "B"): 3.0}
    spot = spark.createDataFrame([("B", DAY, 2.9, 1.0), ("C", DAY, 1.0, 1.0), ("B", 0, 9.0, 0.0)], "symbol string, ts_ms long, close double, quote_volume double")
    wide = N.add_spot(p, spot)
    assert {(r.d_idx, r.symbol, r.s_idx, r.close) for r in wide.where("symbol LIKE 'SPOT%'").collect()} == {(0, "SPOT:B", 2, None), (1, "SPOT:B", 2, 2.9)}
    assert [tuple(r) for r in N.spot_of(wide).collect()] == [("B", "SPOT:B")]
