"""Weights decided at the close of a day from data up to it: (d_idx, symbol, s_idx, w), and the days that rebalance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import log, ratio, weekday
from .panel import average_volume, daily_return, live, trailing_funding, trailing_vol

OUT = ("d_idx", "day_ms", "symbol", "s_idx", "w")


def _day():
    return W.partitionBy("d_idx")


def leg_size(n: Column, frac: float) -> Column:
    return F.greatest(F.lit(1), F.floor(n * F.lit(frac))).cast("int")


def _inverse_vol(rows: DataFrame) -> DataFrame:
    """w of rows with leg +1 or -1 and vol: half the book a leg, by inverse volatility, none where that is not positive."""
    inverse = F.when(F.col("vol") > 0, 1 / F.col("vol")).otherwise(0.0)
    rows = rows.withColumn("_iv", inverse)
    total = F.sum("_iv").over(W.partitionBy("d_idx", "leg"))
    return rows.withColumn("w", F.coalesce(F.col("leg") * 0.5 * ratio("_iv", total), F.lit(0.0))).drop("_iv")


def trend(panel: DataFrame, lookbacks: tuple[int, ...] = (10, 20, 40, 80, 160), vol_window: int = 30, vol_target: float = 0.5, max_gross: float = 1.0) -> DataFrame:
    """Long or flat: the share of lookbacks below the close, over volatility, scaled to max_gross."""
    by = W.partitionBy("symbol").orderBy("d_idx")
    rows = panel.withColumn("r", daily_return())
    past = [F.lag("close", n).over(by) for n in lookbacks]
    rows = rows.withColumns(
        {
            "vol": trailing_vol("r", vol_window) * F.sqrt(F.lit(365.0)),
            "_n": F.count("r").over(by.rowsBetween(-(vol_window - 1), 0)),
            "_score": reduce(lambda a, b: a + b, [(F.col("close") > p).cast("double") for p in past]) / len(lookbacks),
        }
    )
    rows = rows.where((F.col("d_idx") >= max(lookbacks)) & F.col("_score").isNotNull() & (F.col("_n") >= 0.8 * vol_window) & (F.col("vol") > 0))
    rows = rows.withColumn("_raw", F.col("_score") * vol_target / F.col("vol") / F.count("*").over(_day()))
    gross = F.sum(F.abs("_raw")).over(_day())
    return rows.withColumn("w", F.col("_raw") * F.when(gross > max_gross, max_gross / gross).otherwise(1.0)).select(*OUT)


def carry(panel: DataFrame, lookback: int = 7, frac: float = 1 / 3, rebalance_weekday: int = 0) -> tuple[DataFrame, DataFrame]:
    """(weights, rebalance days): long the lowest, short the highest trailing funding; with fewer than six live coins flat."""
    rows = panel.withColumns({"f": trailing_funding(lookback), "_live": live(lookback)})
    rows = rows.where((F.col("d_idx") >= lookback) & (weekday("day_ms") == rebalance_weekday))
    reb = rows.select("d_idx", "day_ms").distinct()
    n = F.count("*").over(_day())
    ranked = rows.where("_live").withColumns({"_n": n, "_rank": F.row_number().over(_day().orderBy("f", "s_idx"))}).where("_n >= 6").withColumn("_k", leg_size(F.col("_n"), frac))
    side = F.when(F.col("_rank") > F.col("_n") - F.col("_k"), -0.5 / F.col("_k")).when(F.col("_rank") <= F.col("_k"), 0.5 / F.col("_k"))
    return ranked.withColumn("w", side).where("w IS NOT NULL").select(*OUT), reb


def _universe(panel: DataFrame, top_n: int, min_history: int, start: int, least: int, on: str) -> DataFrame:
    """Eligible rows by day: top_n by average volume among the live; days with fewer than `least` (live or top) have none."""
    rows = panel.withColumns({"_live": live(min_history), "adv": average_volume(min_history)}).where(F.col("_live") & (F.col("d_idx") >= start))
    rows = rows.withColumns({"_n": F.count("*").over(_day()), "adv_rank": F.row_number().over(_day().orderBy(F.desc("adv"), "s_idx"))})
    size = F.col("_n") if on == "live" else F.least(F.col("_n"), F.lit(top_n))
    return rows.where((size >= least) & (F.col("adv_rank") <= top_n)).drop("_live", "_n")


def _two_legs(top: DataFrame, order: str, frac: float, long_high: bool) -> DataFrame:
    ranked = top.withColumns({"_n": F.count("*").over(_day()), "_rank": F.row_number().over(_day().orderBy(order, "adv_rank"))}).withColumn("_k", leg_size(F.col("_n"), frac))
    high = 1 if long_high else -1
    leg = F.when(F.col("_rank") > F.col("_n") - F.col("_k"), high).when(F.col("_rank") <= F.col("_k"), -high)
    return _inverse_vol(ranked.withColumn("leg", leg).where("leg IS NOT NULL")).select(*OUT)


def broad_carry(panel: DataFrame, top_n: int = 60, lookback: int = 7, vol_window: int = 30, min_history: int = 30, frac: float = 1 / 3, rebalance_weekday: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weights, rebalance days, eligible rows): carry on a point-in-time universe; with fewer than six live coins nothing trades."""
    rows = panel.withColumns({"f": trailing_funding(lookback), "r": daily_return()}).withColumn("vol", trailing_vol("r", vol_window))
    top = _universe(rows, top_n, min_history, max(min_history, vol_window, lookback), 6, "live")
    week = top.where(weekday("day_ms") == rebalance_weekday)
    return _two_legs(week, "f", frac, long_high=False), week.select("d_idx", "day_ms").distinct(), top.select("d_idx", "symbol", "s_idx")


def momentum(panel: DataFrame, top_n: int = 100, lookback: int = 28, vol_window: int = 30, min_history: int = 60, frac: float = 0.2, rebalance_weekday: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weights, rebalance days, eligible rows): long the strongest, short the weakest; with fewer than ten coins nothing trades."""
    by = W.partitionBy("symbol").orderBy("d_idx")
    rows = panel.withColumns({"r": daily_return(), "mom": log("close") - F.lag(log("close"), lookback).over(by)}).withColumn("vol", trailing_vol("r", vol_window))
    top = _universe(rows, top_n, min_history, max(min_history, lookback, vol_window), 10, "top")
    week = top.where(weekday("day_ms") == rebalance_weekday)
    return _two_legs(week, "mom", frac, long_high=True), week.select("d_idx", "day_ms").distinct(), top.select("d_idx", "symbol", "s_idx")


def permuted(weights: DataFrame, eligible: DataFrame, seed: int | Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each day's weights dealt anew among the eligible symbols: as many positions, the same exposure, random coins.

    keys: columns of eligible that tell simulations apart, each of which is dealt on its own.
    """
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    day = W.partitionBy(*keys, "d_idx")
    rows = eligible.join(weights.select("d_idx", "symbol", "w"), ["d_idx", "symbol"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    dealt = rows.select(*keys, "d_idx", "symbol", "s_idx", F.row_number().over(day.orderBy("s_idx")).alias("_k"))
    values = rows.select(*keys, "d_idx", "w", F.row_number().over(day.orderBy(F.xxhash64("d_idx", "symbol", seed), "s_idx")).alias("_k"))
    return dealt.join(values, [*keys, "d_idx", "_k"]).drop("_k").where("w <> 0")


def start_from(weights: DataFrame, rebalance: DataFrame, lo: int) -> DataFrame:
    """The weights that hold at day lo: those of the last rebalance day up to it, dated lo."""
    last = rebalance.where(F.col("d_idx") <= lo).agg(F.max("d_idx").alias("d_idx"))
    return weights.join(F.broadcast(last), "d_idx").withColumn("d_idx", F.lit(lo))
