"""Sources, bars, as-of joins, features, pairs and statistics."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import columns as C
from barloom.functions import normal, unitroot
from barloom.operators import asof as A
from barloom.operators import bars as B
from barloom.operators import features as X
from barloom.operators import funding as FU
from barloom.operators import learn as L
from barloom.operators import pairs as P
from barloom.operators import stats as T
from barloom.operators import weights as WT
from barloom.plans import walkforward as WF
from barloom.sources import manifest, readers, sinks, synthetic

M, H, DAY = 60_000, 3_600_000, 86_400_000


def test_symbols_and_small_columns(spark):
    rows = spark.createDataFrame([(x,) for x in ("DOT/USDT", "DOTUSDT", "DOT_USDT", "DOT/USDT:USDT")], "s string")
    assert {r[0] for r in rows.select(C.symbol_stem("s")).collect()} == {"DOT_USDT"}
    row = spark.range(1).select(C.weekday(F.lit(0)).alias("w"), C.finite(F.lit(float("nan"))).alias("n"), C.log(F.lit(-1.0)).alias("l"), C.ratio(F.lit(1.0), F.lit(0.0)).alias("d"), C.bucket(F.lit(-1), 10).alias("b")).first()
    assert (row.w, row.n, row.l, row.d, row.b) == (4, None, None, None, -10)
    assert (C.bars_in(1440, 5), C.bars_in(1, 60)) == (288, 1)


def test_kline_files(spark, tmp_path):
    pdf = pd.DataFrame({"timestamp": [0, M, M, 2 * M, 3 * M, 4 * M], "open": 1.0, "high": 1.0, "low": 1.0, "close": [1.0, 2, 3, 4, 5, 6], "volume": [5.0, 0, 7, 0, 0, 2], "taker_buy_volume": 1.0})
    pdf.to_parquet(f"{tmp_path}/DOT_USDT_1m.parquet")
    own = readers.read_klines(spark, f"{tmp_path}/*_1m.parquet")
    assert [(r.symbol, r.ts_ms, r.close) for r in own.orderBy("ts_ms").collect()] == [("DOT_USDT", 0, 1), ("DOT_USDT", M, 3), ("DOT_USDT", 4 * M, 6)]
    assert readers.read_klines(spark, f"{tmp_path}/*_1m.parquet", drop_untraded=False).count() == 5
    digests = manifest.file_digests(spark, f"{tmp_path}/*.parquet")
    assert len(digests) == 1 and manifest.manifest({"a": 1}, digests)["data"] == manifest.data_digest(digests)


def test_csv_files(spark, tmp_path):
    line = "1704067200000,1,2,0.5,1.5,10,1704067259999,15,3,4,6,0"
    (tmp_path / "a.csv").write_text("open_time,open,high,low,close,volume,close_time,quote_volume,count,taker_buy_volume,taker_buy_quote_volume,ignore\n" + line + "\n")
    (tmp_path / "b.csv").write_text(line.replace("1704067200000", "1704067200000000") + "\n")
    rows = readers.read_kline_csv(spark, f"{tmp_path}/[ab].csv").collect()
    assert {(r.ts_ms, r.close, r.volume) for r in rows} == {(1_704_067_200_000, 1.5, 10.0)} and len(rows) == 2
    (tmp_path / "f.csv").write_text("calc_time,funding_interval_hours,last_funding_rate\n28800000,8,0.0001\n57600000,8,-0.0002\n")
    assert [r.funding_rate for r in readers.read_funding_csv(spark, f"{tmp_path}/f.csv").orderBy("ts_ms").collect()] == [1e-4, -2e-4]
    (tmp_path / "t.csv").write_text("observation_date,DTB3\n1970-01-02,3.60\n1970-01-03,.\n1970-01-04,7.20\n")
    bills = readers.read_tbill_csv(spark, f"{tmp_path}/t.csv")
    days = spark.range(5).select(F.lit(1).alias("k"), (F.col("id") * DAY).alias("day_ms"))
    out = A.asof(days, bills.select(F.lit(1).alias("k"), "day_ms", "rate"), ["k"], ["rate"], ts="day_ms", strict=True).orderBy("day_ms").collect()
    assert [r.rate for r in out] == [None, None, pytest.approx(0.036 / 360), pytest.approx(0.036 / 360), pytest.approx(0.072 / 360)]
    (tmp_path / "k.json").write_text(json.dumps({"candles": [{"time": 1, "open": "1", "high": "1", "low": "1", "close": "2", "volume": "3"}, {"time": 1, "open": "9", "high": "9", "low": "9", "close": "9", "volume": "9"}]}))
    (row,) = readers.read_candle_json(spark, f"{tmp_path}/k.json").collect()
    assert (row.ts_ms, row.close, row.quote_volume) == (1, 2.0, 6.0)


def test_zip_checksums_and_sinks(spark, tmp_path):
    import hashlib
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", "x,y\n1,2\n")
    assert [r.line for r in readers.read_zip_members(spark, f"{tmp_path}/a.zip").orderBy("line_no").collect()] == ["x,y", "1,2"]
    found = readers.checksums(spark, f"{tmp_path}/a.zip")
    good = hashlib.sha256((tmp_path / "a.zip").read_bytes()).hexdigest()
    name = found.first().file
    assert readers.failed_checksums(found, spark.createDataFrame([(name, good)], "file string, sha256 string")).count() == 0
    assert readers.failed_checksums(found, spark.createDataFrame([(name, "00"), ("b", good)], "file string, sha256 string")).count() == 2
    bars = spark.createDataFrame([("A", 2, 1.0), ("B", 1, 1.0), ("A", 1, 2.0)], "symbol string, ts_ms long, close double")
    sinks.write_bars(bars, f"{tmp_path}/bars")
    assert spark.read.parquet(f"{tmp_path}/bars").where("symbol = 'A'").count() == 2
    sinks.write_results(bars, f"{tmp_path}/csv", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 3


def test_instruments(spark):
    rows = spark.createDataFrame([("flexible_futures", True, "XBT"), ("flexible_futures", True, "1000X"), ("flexible_futures", False, "A"), ("spot", True, "B"), ("flexible_futures", True, "É")], "type string, tradeable boolean, base string")
    assert [r.base for r in readers.tradable_instruments(rows).collect()] == ["BTC"]


def minutes(spark, closes, opens=None):
    n = len(closes)
    opens = opens or closes
    return spark.createDataFrame([("A", k * M, float(o), max(o, c) + 1.0, min(o, c) - 0.1, float(c), 1.0, 0.5) for k, (o, c) in enumerate(zip(opens, closes))], readers.BARS)


def test_resample(spark):
    out = B.resample(minutes(spark, [k + 1.5 - 1 for k in range(1, 11)], list(range(1, 11))), 5).orderBy("ts_ms").collect()
    assert [r.open for r in out] == [1, 6] and [r.close for r in out] == [5.5, 10.5] and [r.n_minutes for r in out] == [5, 5]
    assert [r.volume for r in out] == [5, 5]


def test_validation_counts(spark):
    rows = [("A", 0, 1.0, 2.0, 0.5, 1.0, 0), ("A", 2 * M, 1.0, 0.5, 0.4, 1.0, 1), ("A", M, 1.0, 2.0, 0.5, 1.0, 2), ("A", 10 * M, -1.0, 1.0, -2.0, 1.0, 3), ("A", 10 * M, 1.0, 1.0, 1.0, 1.0, 4)]
    r = B.validate(spark.createDataFrame(rows, "symbol string, ts_ms long, open double, high double, low double, close double, seq int"), 1, "seq").first()
    assert (r.n_rows, r.duplicates, r.unsorted, r.bad_ohlc, r.non_positive, r.gaps, r.largest_gap_min, r.ok) == (5, 1, 1, 1, 1, 1, 8.0, False)


@pytest.mark.parametrize("piece", [None, 5])
def test_asof_with_equal_times(spark, piece):
    left = spark.createDataFrame([("a", t, t) for t in (0, 5, 10, 23)] + [("b", 5, 5)], "k string, ts_ms long, v long")
    right = spark.createDataFrame([("a", 5, 1.0, 0), ("a", 5, 2.0, 1), ("a", 9, 3.0, 0)], "k string, ts_ms long, r double, seq int")
    got = lambda strict: {(r.k, r.ts_ms): r.r for r in A.asof(left, right, ["k"], ["r"], strict=strict, order=F.col("seq"), slice_ms=piece).collect()}
    assert got(False) == {("a", 0): None, ("a", 5): 2.0, ("a", 10): 3.0, ("a", 23): 3.0, ("b", 5): None}
    assert got(True) == {("a", 0): None, ("a", 5): None, ("a", 10): 3.0, ("a", 23): 3.0, ("b", 5): None}


def test_premium_reconstruction(spark):
    day = lambda v, n=1440: spark.createDataFrame([("A", k * M, v) for k in range(n)], "symbol string, open_time long, premium_close double")
    assert [r.funding_rate for r in FU.reconstruct(day(0.0), 8).collect()] == [pytest.approx(1e-4)] * 3
    assert [r.funding_rate for r in FU.reconstruct(day(0.002), 8).collect()] == [pytest.approx(0.0015)] * 3
    short = {r.ts_ms: r.funding_rate for r in FU.reconstruct(day(0.0, 800), 8).collect()}
    assert short[8 * H] == pytest.approx(1e-4) and short[16 * H] is None
    with pytest.raises(ValueError):
        FU.reconstruct(day(0.0), 7)
    events = spark.createDataFrame([("A", k * 4 * H) for k in range(12)] + [("B", k * 3 * H) for k in range(9)] + [("C", 0)], "symbol string, ts_ms long")
    assert {r.symbol: r.hours for r in FU.interval_hours(events).collect()} == {"A": 4, "B": None, "C": None}


def test_proxy_validation(spark):
    r = np.random.default_rng(0)
    rows = []
    for proxy, noise in (("mark", 1e-5), ("trade", 1e-2)):
        for d in range(40):
            x = float(r.normal(6e-4, 3e-4))
            rows.append((proxy, "A", d * DAY, x, x + float(r.normal(0, noise))))
    out = {x.proxy: x for x in FU.validate_proxies(spark.createDataFrame(rows, "proxy string, symbol string, day_ms long, funding double, funding_r double")).collect()}
    assert out["mark"].chosen and out["mark"].passed and not out["trade"].chosen
    candles = spark.createDataFrame([("A", 0, 101.0, 101.0)], "symbol string, ts_ms long, open double, close double")
    index = spark.createDataFrame([("A", 0, 100.0, 100.0)], "symbol string, ts_ms long, open double, close double")
    terms = spark.createDataFrame([("A", 2.0, 0.004)], "symbol string, k double, cap double")
    (row,) = FU.from_candles(candles, index, terms).collect()
    assert (row.ts_ms, row.funding_rate) == (H, 0.004)


# ---------------------------------------------------------------- features and causality


@pytest.fixture(scope="module")
def pair_bars(spark):
    bars = B.resample(synthetic.cointegrated(spark, 60 * 24 * 5, 1), 60)
    pairs = spark.createDataFrame([("P0", "P0A/USDT", "P0B/USDT", 0.3, 1.0)], "pair string, asset1 string, asset2 string, alpha double, beta double")
    rows = B.align(bars, pairs, ("alpha", "beta")).withColumn("btc_close", F.col("close2"))
    return spark.createDataFrame(rows.toPandas())


def test_features_see_no_future(spark, pair_bars):
    cut = pair_bars.agg(F.percentile("ts_ms", F.lit(0.7))).first()[0] // H * H
    wild = pair_bars
    for c in ("close1", "close2", "volume1", "open1", "btc_close", "taker_buy_volume2"):
        wild = wild.withColumn(c, F.when(F.col("ts_ms") > cut, F.col(c) * 3 + 1).otherwise(F.col(c)))
    run = lambda f: X.pair_features(f, 60, btc=True, adf=True).where(F.col("ts_ms") <= cut).select("ts_ms", *X.FEATURES).orderBy("ts_ms").toPandas()
    a, b = run(pair_bars), run(wild)
    pd.testing.assert_frame_equal(a, b)
    assert a.z_24h.notna().any() and a.adf_pvalue_24h.notna().any()
    y = pair_bars.withColumn("spread", C.log("close1") - C.log("close2")).withColumn("y", X.forward_return("spread", "beta", ["pair"], "ts_ms", 3))
    assert y.where("y IS NULL").count() == 3


def test_adf_resets_where_it_cannot_be_evaluated(spark):
    rows = [("P", k * H, float(np.sin(k)) if k < 30 else 1.0) for k in range(60)]
    out = X.with_adf(spark.createDataFrame(rows, "pair string, ts_ms long, spread double"), 20).orderBy("ts_ms").toPandas()
    assert out.adf_pvalue_24h[:19].isna().all() and out.adf_pvalue_24h[19:40].notna().all() and out.adf_pvalue_24h[55:].isna().all()


def test_weights_see_no_future(spark):
    r = np.random.default_rng(3)
    rows = [(d, d * DAY, f"S{s:02}", s, float(np.exp(r.normal())), float(r.normal(0, 1e-3)), float(r.lognormal())) for d in range(60) for s in range(14)]
    p = spark.createDataFrame(rows, "d_idx int, day_ms long, symbol string, s_idx int, close double, funding double, quote_volume double")
    wild = p.withColumns({c: F.when(F.col("d_idx") > 40, F.col(c) * 5 + 1).otherwise(F.col(c)) for c in ("close", "funding", "quote_volume")})
    for make in (lambda x: WT.trend(x, (2, 4, 8), 10), lambda x: WT.carry(x)[0], lambda x: WT.broad_carry(x, 10, 7, 10, 10)[0], lambda x: WT.momentum(x, 12, 7, 10, 10)[0]):
        own = lambda x: sorted(map(tuple, make(x).where("d_idx <= 40").collect()))  # noqa: B023, E731
        assert own(p) == own(wild) and own(p)
    w, reb, elig = WT.momentum(p, 12, 7, 10, 10)
    dealt = WT.permuted(w, elig.join(reb.select("d_idx"), "d_idx", "left_semi"), 1)
    values = lambda f: sorted((r.d_idx, round(r.w, 12)) for r in f.collect())
    assert values(dealt) == values(w.where("w <> 0"))
    day = reb.agg(F.max("d_idx")).first()[0]
    assert {r.symbol for r in WT.start_from(w, reb, 59).collect()} == {r.symbol for r in w.where(F.col("d_idx") == day).collect()}


# ---------------------------------------------------------------- pairs and statistics


def test_unit_root_values():
    assert unitroot.p_value(-2.86) == pytest.approx(0.0502, abs=1e-3) and unitroot.p_value(-3.34, 2) == pytest.approx(0.0495, abs=1e-3)
    r = np.random.default_rng(0)
    walk, noise = np.cumsum(r.normal(size=500)), r.normal(size=500)
    assert unitroot.adf_p(walk) > 0.05 > unitroot.adf_p(noise)
    assert unitroot.engle_granger_p(walk + noise, walk) < 0.01 < unitroot.engle_granger_p(np.cumsum(r.normal(size=500)), walk)
    assert unitroot.adf_p(np.ones(50)) is None


def test_selection_finds_the_cointegrated_pair(spark):
    bars = B.selection_closes(synthetic.cointegrated(spark, 60 * 300, 2), 0, 2**60, 60)
    symbols = spark.createDataFrame([(s, k) for k, s in enumerate(["P0A/USDT", "P0B/USDT", "P1A/USDT", "P1B/USDT"])], "symbol string, s_idx int")
    stats = P.pair_statistics(bars, P.all_pairs(symbols), 60)
    out = P.choose_pairs(stats, top_k=2, per_asset=1, min_corr=0.0).orderBy("rank").collect()
    assert {r.pair for r in out} == {"P0A_USDT__P0B_USDT", "P1A_USDT__P1B_USDT"} and all(0.4 < r.beta < 1.6 for r in out)
    fake = spark.createDataFrame([("a", "A", "B", 0.01), ("b", "A", "C", 0.02), ("c", "C", "D", 0.03), ("d", "E", "F", 0.2)], "pair string, asset1 string, asset2 string, coint_pvalue double").withColumns({"beta": F.lit(1.0), "half_life_minutes": F.lit(100.0), "return_corr": F.lit(0.9)})
    assert [r.pair for r in P.choose_pairs(fake, per_asset=1).orderBy("rank").collect()] == ["a", "c"]
    assert P.all_pairs(symbols, symbols.limit(1)).count() == 3


def test_sharpe_family(spark):
    x = np.random.default_rng(2).normal(0.001, 0.01, 300)
    rows = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)] + [("b", 0, 0.01)], "label string, d_idx int, ret double")
    out = {r.label: r for r in rows.groupBy("label").agg(T.sharpe().alias("s"), T.sortino().alias("o")).collect()}
    assert out["a"].s == pytest.approx(x.mean() / x.std(ddof=1) * 365**0.5) and out["b"].s == 0 and out["b"].o == 0
    c = {r.label: r for r in T.against_chance(rows, ("label",), 9).collect()}
    assert 0 < c["a"].dsr < c["a"].psr < 1 and c["b"].dsr == 0
    assert normal.expected_max_sharpe(1, 1.0) == 0 and normal.probabilistic_sharpe(0.0, 100, 0, 3) == pytest.approx(0.5)
    (b,) = T.bootstrap_mean(rows.where("label = 'a'"), ("label",), n_boot=4000).collect()
    assert b.lower < b.mean < b.upper and b.upper - b.lower == pytest.approx(2 * 1.96 * x.std() / 300**0.5, rel=0.1)
    blocks = {r.label: r for r in T.block_bootstrap_mean(rows, ("label",)).collect()}
    assert blocks["a"].lower < x.mean() < blocks["a"].upper and blocks["b"].lower is None
    points = spark.createDataFrame([("a", 0, 100.0), ("a", 1, 50.0), ("a", 2, 120.0), ("a", 3, 90.0)], "label string, d_idx int, equity double")
    assert T.drawdowns(points, ("label",), "d_idx").first().max_drawdown == 0.5
    assert T.drawdowns(points, ("label",), "d_idx", start=200.0).first().max_drawdown == 0.75
    days = spark.createDataFrame([("a", 0, 0.1), ("a", DAY, -1.0)], "label string, day_ms long, net double").withColumns({c: F.lit(0.0) for c in ("turnover", "exposure", "gross", "cost", "funding")})
    assert T.daily_summary(days).first().total_return == -1.0
    bills = spark.createDataFrame([(0, 0.01)], "day_ms long, rate double")
    assert T.excess_return(days, bills).first().excess == pytest.approx(-1.0)
    steady = days.withColumn("net", F.lit(0.1))
    assert T.excess_return(steady, bills).first().excess == pytest.approx(1.21 / 1.01 - 1)
    one = T.daily_summary(rows.select("label", F.col("d_idx").cast("long").alias("day_ms"), F.col("ret").alias("net"), *[F.lit(0.0).alias(c) for c in ("turnover", "exposure", "gross", "cost", "funding")]).where("label = 'a'")).first()
    grown = np.cumprod(1 + x)
    assert one.max_drawdown == pytest.approx((1 - np.concatenate([[1], grown]) / np.maximum.accumulate(np.concatenate([[1], grown]))).max()) and one.ci_lower_bp < one.mean_daily_bp < one.ci_upper_bp
    flags = spark.createDataFrame([("a", True, False, True, True), ("a", True, True, False, False)], "label string, entry_maker1 boolean, entry_maker2 boolean, exit_maker1 boolean, exit_maker2 boolean")
    m = T.maker_shares(flags, ("label",)).first()
    assert (m.entry_share, m.entry_both, m.exit_share, m.exit_both) == (0.75, 0.5, 0.5, 0.5)


def test_windows():
    rows = WF.windows(0, 200 * DAY, 90, 30, 20)
    assert rows[0] == (0, 0, 90 * DAY, 90 * DAY, 120 * DAY) and rows[-1] == (2, 60 * DAY, 150 * DAY, 150 * DAY, 180 * DAY)
    assert WF.windows(0, 100 * DAY, 90, 30, 0)[0][4] == 100 * DAY and WF.windows(0, int(90.5 * DAY), 90, 30, 0) == []


def test_edge_on_reverting_pairs_only(spark):
    def mean_gross(bars, a, b):
        pairs = spark.createDataFrame([("p", a, b, 0.3, 1.0, 240.0)], "pair string, asset1 string, asset2 string, alpha double, beta double, half_life_minutes double")
        start = synthetic.START_MS + 2 * DAY
        trades = WF.baseline_trades(bars, pairs, start, start + 8 * DAY, WF.Baseline(15, 720))
        assert trades.where(F.col("entry_ts") <= start).count() == 0
        return trades.agg(F.avg("gross_ret"), F.count("*")).first()

    good, n = mean_gross(synthetic.cointegrated(spark, 60 * 240, 1), "P0A/USDT", "P0B/USDT")
    none, m = mean_gross(synthetic.random_walks(spark, 60 * 240, 2), "A0/USDT", "A1/USDT")
    assert n > 10 and m > 5 and good > 0.002 and abs(none) < good


def test_learned_entries(spark, pair_bars, tmp_path):
    cfg = L.LearnConfig(horizon=3, min_rows=20, rounds=2, ensemble=2)
    rows = L.dataset(X.pair_features(pair_bars, 60), cfg)
    columns = ["z_4h", "z_mom_1"]
    span = pair_bars.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    train = L.fit_slice(rows, span[0], span[1], 3 * H, cfg)
    assert train.agg(F.max("ts_ms")).first()[0] < span[1] - 3 * H
    models = L.fit_ensemble(train, columns, 1, cfg)
    scored = L.predict(rows, models, columns).withColumn("signal", L.entry_with_edge("z_4h", 1.0, F.lit(-1.0), 1.0))
    assert scored.count() == rows.count() and scored.where("pred_ret IS NULL").count() == L.finite_rows(rows, [*columns, "scale"]).select("ts_ms").exceptAll(rows.select("ts_ms")).count() + rows.count() - L.finite_rows(rows, [*columns, "scale"]).count()
    assert L.fit_ensemble(train.limit(5), columns, 1, cfg) is None
    cells = L.grid(spark, cfg)
    assert cells.count() == 9
    scores = cells.select("grid_idx", F.lit(20).alias("n"), F.when(F.col("grid_idx") > 3, 1.0).otherwise(-1.0).alias("score"))
    best = L.best_cell(scores).first()
    assert best.grid_idx == 4 and not best.sits and L.best_cell(scores.withColumn("n", F.lit(3))).first().sits
    L.save_bundle(models, {"pairs": ["P0"], "valid_until_ms": 10}, f"file://{tmp_path}/b")
    again, meta = L.load_bundle(spark, f"file://{tmp_path}/b")
    assert len(again) == 2 and L.allows_entries(meta, 9) and not L.allows_entries(meta, 10)
    L.fit_ensemble(train.where("z_4h > 0"), columns, 7, cfg)[0].write().overwrite().save(f"file://{tmp_path}/b/model-1")
    with pytest.raises(ValueError, match="not those"):
        L.load_bundle(spark, f"file://{tmp_path}/b")


def test_choices_are_made_once(spark, tmp_path):
    from barloom.plans.learned import cached

    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert [cached(f"file://{tmp_path}", d, make).count() for d in ("x", "x", "y")] == [3, 3, 3] and len(made) == 2


def test_blocks_equal_whole_histories(spark):
    """Windows over blocks, gaps over slices and sums over slices against whole keys, with a hot key."""
    r = np.random.default_rng(4)
    rows = [("hot", int(t), float(x)) for t, x in zip(np.cumsum(r.integers(1, 9, 900)), r.normal(size=900))] + [(f"k{k}", k, 1.0) for k in range(5)]
    frame = spark.createDataFrame(rows, "symbol string, ts_ms long, x double").repartition(5)
    for size in (20, 64):
        cut = X.blocks(frame, ["symbol"], "ts_ms", 20, 100, size)
        assert cut.groupBy("symbol", "_block").count().agg(F.max("count")).first()[0] <= size + 20
        z = lambda f, keys: f.withColumn("z", X.zscore("x", keys, "ts_ms", 20))
        got = X.own_rows(z(cut, ["symbol", "_block"])).orderBy("symbol", "ts_ms").toPandas()
        pd.testing.assert_frame_equal(got[["symbol", "ts_ms", "x", "z"]], z(frame, ["symbol"]).orderBy("symbol", "ts_ms").toPandas())
    steps = {(a.symbol, a.ts_ms): a.gap for a in B.gaps(frame, "ts_ms", 50, "gap").collect()}
    hot = sorted(t for s, t, _ in rows if s == "hot")
    assert steps["hot", hot[0]] is None and all(steps["hot", b] == b - a for a, b in zip(hot, hot[1:]))
    sums = {(a.symbol, a.ts_ms): a._sum for a in A.running_sums(frame, ["symbol"], "ts_ms", "x", 70).collect()}
    total = np.cumsum([x for s, _, x in rows if s == "hot"])
    assert all(abs(sums["hot", t] - v) < 1e-9 for t, v in zip(hot, total))


def test_meta_filter(spark):
    r = np.random.default_rng(0)
    rows = [("p", k, 1, float(x), float(x + r.normal(0, 0.3))) for k, x in enumerate(r.normal(size=80))]
    trades = spark.createDataFrame(rows, "pair string, entry_ts long, side int, edge double, net_ret double")
    model = L.fit_meta(trades, ["edge"])
    out = L.accept_meta(trades, model, ["edge"]).collect()
    assert np.mean([(t.net_ret > 0) == t.meta_ok for t in out]) > 0.85
    assert L.fit_meta(trades.limit(10), ["edge"]) is None and all(t.meta_ok for t in L.accept_meta(trades, None, ["edge"]).collect())
    missing = trades.withColumn("edge", F.when(F.col("entry_ts") == 0, math.nan).otherwise(F.col("edge")))
    assert L.fit_meta(missing, ["edge"]) is None
    assert not [t for t in L.accept_meta(missing, model, ["edge"]).collect() if t.entry_ts == 0][0].meta_ok
