"""Queries that write files of the markets' formats from the driver's tables and read them again, and smaller operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import bars as B
from ..operators import funding as FU
from ..operators import learn as L
from ..operators import panel as N
from ..operators import pairs as P
from ..operators import simulate as S
from ..operators import stats as T
from ..operators import weights as WT
from ..sources import readers as R
from ..sources import sinks
from . import catalogue as K
from . import paths as Q
from . import walkforward as WF
from .catalogue import BARS, DAY, HOUR, PAIRS, PANEL, TICKS, query


def _path(spark, label: str) -> str:
    return f"{K._scratch(spark)}/files/{label}-{uuid.uuid4().hex}"


def _two_versions(spark, sf_dir, suffix: str, value: str, first, last, *more: str) -> str:
    """A folder a symbol; every row stands twice, its last version after the first."""
    bars = K.hourly(spark, sf_dir).withColumn("taker_buy_volume", F.col("volume") / 2)
    both = bars.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = both.select(F.concat("symbol", F.lit(suffix)).alias("f"), F.col("ts_ms").alias("timestamp"), *more, F.when(F.col("v") == 0, first).otherwise(last).alias(value), "v")
    path = _path(spark, "files" + suffix)
    rows.repartition("f").sortWithinPartitions("f", "timestamp", "v").drop("v").write.partitionBy("f").parquet(path)
    return path


@query("SELECT 'N' || n_nationkey || v AS symbol, 'N' || n_nationkey || '_USDT' AS stem FROM nation, (VALUES ('USDT'), ('/USDT'), ('_USDT'), ('/USDT:USDT')) t(v)")
def symbol_names(spark, sf_dir):
    kinds = F.explode(F.array(*[F.lit(x) for x in ("USDT", "/USDT", "_USDT", "/USDT:USDT")]))
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("base"), kinds.alias("kind"))
    return names.select(F.concat("base", "kind").alias("symbol")).withColumn("stem", C.symbol_stem("symbol"))


@query(f"WITH {BARS} SELECT symbol, ts_ms, open, high, low, close, volume, volume / 2 AS taker_buy_volume FROM bars WHERE n_ticks > 1")
def scan_klines(spark, sf_dir):
    """The last version of a minute holds before untraded ones go."""
    path = _two_versions(spark, sf_dir, "_1m", "volume", F.col("volume") * 2, F.when(F.col("n_ticks") > 1, F.col("volume")).otherwise(0.0), "open", "high", "low", "close", "taker_buy_volume")
    return R.read_klines(spark, path)


@query(f"WITH {BARS} SELECT symbol, ts_ms, n_ticks * 1e-5 AS funding_rate FROM bars")
def scan_funding(spark, sf_dir):
    return R.read_funding(spark, _two_versions(spark, sf_dir, "_funding", "funding_rate", F.lit(9.0), F.col("n_ticks") * F.lit(1e-5)))


@query(f"WITH {PANEL} SELECT symbol, d_idx::BIGINT * 86400000 AS ts_ms, round(close, 4) AS close, round(quote_volume, 2) AS quote_volume, high FROM daily")
def scan_daily_universe(spark, sf_dir):
    path, rows = _path(spark, "daily"), K.nation_panel(spark, sf_dir).where("close IS NOT NULL")
    rows.select(F.concat("symbol", F.lit("_1d")).alias("f"), F.col("day_ms").alias("timestamp"), "close", "quote_volume", "high").repartition("f").write.partitionBy("f").parquet(path)
    return K.rounded(K.rounded(R.read_daily_universe(spark, path), 4, "close"), 2, "quote_volume")


def _kline_lines(spark, sf_dir) -> str:
    """Archives of text, a folder a symbol, each with a header line; every second time is in microseconds."""
    bars = K.hourly(spark, sf_dir)
    names = [n.strip() for n in R.KLINE_CSV.split(",")]
    time = F.when(F.col("ts_ms") % (2 * HOUR) == 0, F.col("ts_ms") * 1000).otherwise(F.col("ts_ms"))
    own = {"open_time": time, "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume", "quote_volume": F.col("volume") * F.col("close"), "taker_buy_volume": F.col("volume") / 2}
    cell = lambda n: (F.col(own[n]) if isinstance(own.get(n), str) else own.get(n, F.lit(0))).cast("string").alias(n)
    head = bars.select("symbol").distinct().select("symbol", *[F.lit(n).alias(n) for n in names])
    path = _path(spark, "klines")
    head.unionByName(bars.select("symbol", *[cell(n) for n in names])).repartition("symbol").write.partitionBy("symbol").csv(path)
    return path


def _owner():
    return F.regexp_extract("file", "symbol=([^/]+)", 1).alias("symbol")


@query(f"WITH {BARS} SELECT symbol, ts_ms, open, high, low, close, volume, round(volume * close, 6) AS quote_volume, volume / 2 AS taker_buy_volume FROM bars")
def kline_csv(spark, sf_dir):
    return K.rounded(R.read_kline_csv(spark, _kline_lines(spark, sf_dir)).select(_owner(), "ts_ms", "open", "high", "low", "close", "volume", "quote_volume", "taker_buy_volume"), 6, "quote_volume")


@query(f"WITH {BARS} SELECT symbol, ts_ms, close, round(volume * close, 6) AS quote_volume, high FROM bars")
def daily_csv(spark, sf_dir):
    return K.rounded(R.read_daily_csv(spark, _kline_lines(spark, sf_dir)).select(_owner(), "ts_ms", "close", "quote_volume", "high"), 6, "quote_volume")


@query(f"WITH {BARS} SELECT symbol, ts_ms AS open_time, close AS premium_close FROM bars")
def premium_csv(spark, sf_dir):
    return R.read_premium_csv(spark, _kline_lines(spark, sf_dir)).select(_owner(), "open_time", "premium_close")


@query(f"WITH {BARS} SELECT ts_ms, n_ticks * 1e-5 AS funding_rate FROM bars WHERE symbol = 'purchase'")
def funding_csv(spark, sf_dir):
    path, bars = _path(spark, "funding"), K.hourly(spark, sf_dir).where("symbol = 'purchase'")
    bars.select((F.col("ts_ms") * 1000).alias("calc_time"), F.lit(8).alias("funding_interval_hours"), (F.col("n_ticks") * F.lit(1e-5)).alias("last_funding_rate")).coalesce(1).write.option("header", True).csv(path)
    return R.read_funding_csv(spark, path)


_QUOTES = "q AS (SELECT DISTINCT o_orderdate::DATE AS d, (day(o_orderdate) % 10)::DOUBLE AS v FROM orders)"


@query(f"WITH {_QUOTES} SELECT epoch_ms(d) AS day_ms, round(v / 100 / 360, 9) AS rate FROM q WHERE v <> 5")
def tbill_csv(spark, sf_dir):
    path, days = _path(spark, "bills"), spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    quote = F.when(F.dayofmonth("d") % 10 == 5, ".").otherwise((F.dayofmonth("d") % 10).cast("string"))
    lines = days.select(F.col("d").cast("string").alias("observation_date"), quote.alias("DTB3"))
    lines.write.option("header", True).csv(path)
    return K.rounded(R.read_tbill_csv(spark, path), 9, "rate")


@query(f"WITH {BARS} SELECT symbol, ts_ms, open, high, low, close, volume, round(volume * close, 6) AS quote_volume FROM bars")
def candle_json(spark, sf_dir):
    """Each candle twice; the first holds."""
    path, bars = _path(spark, "candles"), K.hourly(spark, sf_dir)
    cells = lambda f: F.struct(F.col("ts_ms").alias("time"), *[(F.col(c) * f).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")])
    docs = bars.groupBy("symbol").agg(F.concat(F.collect_list(cells(1.0)), F.collect_list(cells(2.0))).alias("candles"))
    docs.repartition("symbol").write.partitionBy("symbol").json(path)
    return K.rounded(R.read_candle_json(spark, path).select(_owner(), "ts_ms", "open", "high", "low", "close", "volume", "quote_volume"), 6, "quote_volume")


@query(f"WITH {BARS} SELECT symbol, ts_ms, close, n_ticks FROM bars WHERE symbol = 'purchase'")
def bars_sink(spark, sf_dir):
    path = _path(spark, "bars")
    sinks.write_bars(K.hourly(spark, sf_dir), path)
    return spark.read.parquet(path).where("symbol = 'purchase'").select("symbol", "ts_ms", "close", "n_ticks")


@query("SELECT kind, n_nationkey, n_name FROM nation, (VALUES ('csv'), ('json')) t(kind)")
def result_sinks(spark, sf_dir):
    rows, out = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name"), []
    for kind in ("csv", "json"):
        path = _path(spark, kind)
        sinks.write_results(rows, path, kind)
        reader = spark.read.schema(rows.schema)
        out.append((reader.option("header", True).csv(path) if kind == "csv" else reader.json(path)).withColumn("kind", F.lit(kind)))
    return out[0].unionByName(out[1])


# ---------------------------------------------------------------- smaller operators


@query(f"WITH {PANEL} SELECT symbol, min(d_idx)::BIGINT * 86400000 AS first_ms FROM daily WHERE quote_volume > 0 GROUP BY symbol")
def listing_days(spark, sf_dir):
    return T.listing_days(K.nation_panel(spark, sf_dir).withColumnRenamed("day_ms", "ts_ms"))


@query(f"WITH {BARS} SELECT symbol, ts_ms, CASE WHEN n_ticks % 2 = 1 THEN 0.5 * volume ELSE volume * 0.25 END AS taker_buy_volume FROM bars")
def neutral_taker_volume(spark, sf_dir):
    bars = K.hourly(spark, sf_dir).withColumn("taker_buy_volume", F.when(F.col("n_ticks") % 2 == 0, F.col("volume") * 0.25))
    return B.neutral_taker_volume(bars).select("symbol", "ts_ms", "taker_buy_volume")


_MONTH = "strftime(make_date(1970, 1, 1) + d_idx::INTEGER, '%Y-%m')"


@query(f"WITH {PANEL} SELECT symbol, {_MONTH} AS month FROM daily WHERE quote_volume > 0 EXCEPT SELECT symbol, {_MONTH} FROM daily WHERE d_idx % 40 < 20 AND symbol < 'NATION_2'")
def uncovered_months(spark, sf_dir):
    days = K.nation_panel(spark, sf_dir)
    covered = days.where("close IS NOT NULL AND d_idx % 40 < 20 AND symbol < 'NATION_2'").select("symbol", F.date_format(F.timestamp_millis("day_ms"), "yyyy-MM").alias("month"))
    return N.uncovered_months(days, covered)


@query(f"WITH {BARS} SELECT symbol FROM bars WHERE close > 90 UNION SELECT symbol FROM bars WHERE n_ticks > 1")
def symbol_union(spark, sf_dir):
    bars = K.hourly(spark, sf_dir)
    return N.symbol_union(bars.where("close > 90"), bars.where("n_ticks > 1"))


@query(f"WITH {BARS} SELECT symbol, ts_ms + 3600000 AS ts_ms, round(greatest(-0.003, least(0.003, ((open + close) / 2 / ((low + high) / 2) - 1) / 8)), 9) + 0 AS funding_rate FROM bars")
def candle_funding(spark, sf_dir):
    """Rates from a proxy candle and an index candle, here the bar's ends and its range."""
    bars = K.hourly(spark, sf_dir)
    index = bars.select("symbol", "ts_ms", F.col("low").alias("open"), F.col("high").alias("close"))
    terms = bars.select("symbol").distinct().select("symbol", F.lit(8.0).alias("k"), F.lit(0.003).alias("cap"))
    return K.rounded(FU.from_candles(bars, index, terms), 9, "funding_rate")


_BY_DAY = "SELECT symbol, CAST((ceil(ts_ms / 86400000.0) - 1) * 86400000 AS BIGINT) AS day_ms, sum(price) AS s, count(*) AS n FROM ticks WHERE {w} GROUP BY ALL"


@query(f"WITH {TICKS}, a AS ({_BY_DAY.format(w='true')}), b AS ({_BY_DAY.format(w='seq % 4 > 0')}) SELECT symbol, day_ms, round(a.s, 4) AS funding, round(b.s * 1.5, 4) AS funding_r FROM a JOIN b USING (symbol, day_ms) WHERE a.n >= 3 AND b.n >= 3")
def funding_days(spark, sf_dir):
    events = R.events_as_bars(spark, sf_dir).withColumn("funding_rate", F.col("price"))
    rebuilt = events.where("seq % 4 > 0").withColumn("funding_rate", F.col("price") * 1.5)
    return K.rounded(FU.compare_days(events, rebuilt, least=3), 4, "funding", "funding_r")


_ENTRY = "SELECT proxy, symbol, d_idx FROM (SELECT *, sum({v}) OVER q AS s, d_idx - lag(d_idx, 6) OVER (PARTITION BY proxy, symbol ORDER BY d_idx) AS span FROM pd WINDOW q AS (PARTITION BY proxy, symbol ORDER BY d_idx ROWS 6 PRECEDING)) WHERE span = 6 AND round(s, 9) >= 0.0035"


@query(f"""WITH {PANEL}, pd AS (SELECT proxy, symbol, d_idx, round(funding, 6) AS f, round(funding * k + 0.0001 * (d_idx % 3), 6) AS r FROM daily, (VALUES ('mark', 0.9), ('trade', 0.2)) t(proxy, k)),
st AS (SELECT proxy, corr(f, r) AS corr, count(*) AS n_days, count(DISTINCT symbol) AS n_symbols FROM pd GROUP BY proxy), ea AS ({_ENTRY.format(v='f')}), er AS ({_ENTRY.format(v='r')}),
ju AS (SELECT proxy, count(*) AS n_any, count(*) FILTER (n = 2) AS n_both FROM (SELECT proxy, symbol, d_idx, count(*) AS n FROM (SELECT * FROM ea UNION ALL SELECT * FROM er) GROUP BY ALL) GROUP BY proxy)
SELECT proxy, round(corr, 6) AS corr, n_days, n_symbols, n_any, n_both, round(n_both / n_any, 6) AS jaccard, row_number() OVER (ORDER BY corr DESC, proxy) = 1 AS chosen, row_number() OVER (ORDER BY corr DESC, proxy) = 1 AND corr >= 0.9 AND coalesce(n_both / n_any >= 0.8, false) AS passed FROM st LEFT JOIN ju USING (proxy)""")
def proxy_validation(spark, sf_dir):
    days = K.nation_panel(spark, sf_dir).where("close IS NOT NULL")
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("proxy"), F.lit(k).alias("k")) for n, k in (("mark", 0.9), ("trade", 0.2))]))
    both = days.select("symbol", "day_ms", "d_idx", "funding", kinds.alias("p"))
    rows = both.select("p.proxy", "symbol", "day_ms", F.round("funding", 6).alias("funding"), F.round(F.col("funding") * F.col("p.k") + 0.0001 * (F.col("d_idx") % 3), 6).alias("funding_r"))
    return K.rounded(FU.validate_proxies(rows), 6, "corr", "jaccard")


@query(f"WITH RECURSIVE {PAIRS}, {Q.MAKER} SELECT reason AS exit_reason, round(avg(((f1 IS NOT NULL)::INTEGER + (f2 IS NOT NULL)::INTEGER) / 2), 6) AS entry_share, round(avg((f1 IS NOT NULL AND f2 IS NOT NULL)::INTEGER), 6) AS entry_both, round(avg(((g1 IS NOT NULL)::INTEGER + (g2 IS NOT NULL)::INTEGER) / 2), 6) AS exit_share, round(avg((g1 IS NOT NULL AND g2 IS NOT NULL)::INTEGER), 6) AS exit_both FROM taken GROUP BY reason")
def maker_shares(spark, sf_dir):
    trades = S.simulate(K._signals(spark, sf_dir), S.ExitRules(max_hold_bars=24), execution=S.Execution("maker"))
    return K.rounded(T.maker_shares(trades, ("exit_reason",)), 6, "entry_share", "entry_both", "exit_share", "exit_both")


@query(f"WITH {K._MOMENTUM} SELECT 40 AS d_idx, symbol, round(w, 6) AS w FROM lw WHERE d_idx = (SELECT max(d_idx) FROM t WHERE d_idx <= 40)")
def start_state(spark, sf_dir):
    w, reb, _ = WT.momentum(K.nation_panel(spark, sf_dir), 12, 3, 6, 4, 0.25)
    return WT.start_from(w, reb, 40).select("d_idx", "symbol", K.r6(F.col("w"), "w"))


@query("WITH r AS (SELECT unnest(range(0, 4)) AS k) SELECT k::INTEGER AS index, 1000 + k * 30 * 86400000 AS train_start, 1000 + (k * 30 + 90) * 86400000 AS train_end, 1000 + (k * 30 + 90) * 86400000 AS test_start, least(1000 + (k * 30 + 120) * 86400000, 1000 + 200::BIGINT * 86400000) AS test_end FROM r")
def walk_windows(spark, sf_dir):
    """290 days of data with a holdout of 90: three whole windows and a short one."""
    return WF.windows_frame(spark, WF.windows(1000, 1000 + 290 * DAY))


@query(f"WITH {PAIRS} SELECT pair, asset1, asset2 FROM prs WHERE asset1 NOT IN ('view') AND asset2 NOT IN ('view')")
def excluded_pairs(spark, sf_dir):
    bars = K.hourly(spark, sf_dir)
    return P.all_pairs(N.numbered_symbols(bars), bars.where("symbol = 'view'").select("symbol").distinct())


@query(f"WITH RECURSIVE {PAIRS}, {Q.TAKER} SELECT pair, exit_ts AS ts_ms, reason AS exit_reason FROM taken ORDER BY exit_ts DESC, pair DESC LIMIT 10")
def recent_trades(spark, sf_dir):
    from ..streaming.engine import recent_trades as latest

    fills = S.simulate(K._signals(spark, sf_dir), S.ExitRules(max_hold_bars=24)).select("pair", F.col("exit_ts").alias("ts_ms"), "exit_reason")
    return latest(fills, 10)


@query(f"WITH RECURSIVE {PAIRS}, {Q.TAKER}, sc AS (SELECT pair, side + 1 AS grid_idx, count(*) AS n, round(sum(side / 1.5 * (x1 / e1 - 1) - side * 0.5 / 1.5 * (x2 / e2 - 1)), 6) AS score FROM taken GROUP BY ALL) SELECT pair, grid_idx, n, CASE WHEN n < 10 THEN '-inf'::DOUBLE ELSE score END AS score, CASE WHEN n < 10 THEN true ELSE score <= 0 END AS sits FROM sc QUALIFY row_number() OVER (PARTITION BY pair ORDER BY CASE WHEN n < 10 THEN '-inf'::DOUBLE ELSE score END DESC, grid_idx) = 1")
def best_cells(spark, sf_dir):
    """The better side of each pair as a grid of two cells."""
    trades = S.simulate(K._signals(spark, sf_dir), S.ExitRules(max_hold_bars=24))
    scores = trades.groupBy("pair", (F.col("side") + 1).alias("grid_idx")).agg(F.count("*").alias("n"), F.round(F.sum("gross_ret"), 6).alias("score"))
    return L.best_cell(scores, ("pair",))


@query(f"WITH {PAIRS}, {Q.SIGNALS} SELECT pair, ts_ms, CASE WHEN signal <> 0 AND signal * round(-z / 100, 6) - 0.5 * round(abs(z) / 1000, 6) > 0.0155 THEN signal ELSE 0 END AS signal FROM sg")
def edge_entries(spark, sf_dir):
    """A cross trades if the predicted return, here a share of z, is worth more than doubt and costs."""
    rows = K._signals(spark, sf_dir).withColumns({"pred_ret": F.round(-F.col("z") / 100, 6), "unc": F.round(F.abs("z") / 1000, 6)})
    return rows.withColumn("signal", L.entry_with_edge("z", 1.5, 0.0155, 0.5)).select("pair", "ts_ms", "signal")


@query(f"WITH {PAIRS} SELECT 'p' AS pair, x.ts_ms, x.close AS close1, y.close AS close2 FROM bars x JOIN bars y ON x.ts_ms = y.ts_ms WHERE x.symbol = 'purchase' AND y.symbol = 'view'")
def stream_leg_join(spark, sf_dir):
    from ..streaming.candles import join_legs

    bars = K.hourly(spark, sf_dir).withColumn("pair", F.lit("p"))
    leg = lambda s: K._stream_of(bars.where(F.col("symbol") == s).drop("symbol"), s)
    return K._drain(join_legs(leg("purchase"), leg("view")), "legs").select("pair", "ts_ms", "close1", "close2")


_Y = "lead(spread, 3) OVER (PARTITION BY pair ORDER BY ts_ms)"


@query(f"""WITH {PAIRS}, u AS (SELECT *, (spread - lag(spread) OVER (PARTITION BY pair ORDER BY ts_ms)) / 1.5 AS unit FROM rows), v AS (SELECT *, CASE WHEN count(unit) OVER w >= 24 THEN stddev_samp(unit) OVER w END * sqrt(3) AS scale, ({_Y} - spread) / 1.5 AS fwd FROM u WINDOW w AS (PARTITION BY pair ORDER BY ts_ms ROWS 23 PRECEDING))
SELECT pair, ts_ms, round(scale, 6) AS scale, round(greatest(-1.5, least(1.5, fwd / nullif(scale, 0))), 6) AS y FROM v WHERE fwd / nullif(scale, 0) IS NOT NULL AND ts_ms < 1704067200000 + 20 * 86400000 - 3 * 3600000""")
def learning_rows(spark, sf_dir):
    """The purged fit slice with its clipped targets."""
    cfg = L.LearnConfig(horizon=3, clip=1.5)
    rows = L.dataset(K._feature_rows(spark, sf_dir, adf=False, minutes=60), cfg)
    return L.fit_slice(rows, 0, 1_704_067_200_000 + 20 * DAY, 3 * HOUR, cfg).select("pair", "ts_ms", K.r6(F.col("scale"), "scale"), K.r6(F.col("y"), "y"))
