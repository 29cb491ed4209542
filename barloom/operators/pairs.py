"""Candidate pairs: enumeration, statistics and the greedy choice."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import log
from ..functions.unitroot import engle_granger_p

PAIR = "pair string, asset1 string, asset2 string"


def all_pairs(symbols: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(pair, asset1, asset2) of every two symbols by s_idx; symbols is a dimension table of (symbol, s_idx)."""
    if excluded is not None:
        symbols = symbols.join(excluded.select("symbol"), "symbol", "left_anti")
    a, b = symbols.alias("a"), F.broadcast(symbols).alias("b")
    name = lambda c: F.regexp_replace(F.col(c), "/", "_")
    return a.join(b, F.col("a.s_idx") < F.col("b.s_idx")).select(F.concat(name("a.symbol"), F.lit("__"), name("b.symbol")).alias("pair"), F.col("a.symbol").alias("asset1"), F.col("b.symbol").alias("asset2"))


def log_pairs(closes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, ts_ms, x1, x2): log closes of both legs where both have one."""
    own = closes.select("symbol", "ts_ms", log("close").alias("x")).where("x IS NOT NULL")
    leg = lambda n: own.join(pairs.select("pair", F.col(f"asset{n}").alias("symbol")), "symbol").select("pair", "ts_ms", F.col("x").alias(f"x{n}"))
    return leg(1).join(leg(2), ["pair", "ts_ms"])


def hedges(rows: DataFrame) -> DataFrame:
    """(pair, n, alpha, beta): least squares of x1 on x2."""
    return rows.groupBy("pair").agg(F.count("*").alias("n"), F.regr_intercept("x1", "x2").alias("alpha"), F.regr_slope("x1", "x2").alias("beta"))


def half_life(rows: DataFrame, fits: DataFrame, bar_minutes: int) -> DataFrame:
    """(pair, half_life_minutes): -ln 2 over the slope of changes on levels of the residual; infinite if that isn't negative."""
    by = W.partitionBy("pair").orderBy("ts_ms")
    rest = rows.join(fits.select("pair", "alpha", "beta"), "pair").withColumn("e", F.col("x1") - F.col("beta") * F.col("x2") - F.col("alpha"))
    step = rest.withColumn("e0", F.lag("e").over(by)).where("e0 IS NOT NULL").withColumn("d", F.col("e") - F.col("e0"))
    slope = step.groupBy("pair").agg(F.regr_slope("d", "e0").alias("s"))
    return slope.select("pair", F.when(F.col("s") < 0, -math.log(2) / F.col("s") * bar_minutes).otherwise(float("inf")).alias("half_life_minutes"))


def return_corr(rows: DataFrame) -> DataFrame:
    """(pair, return_corr) of changes over the common rows; 0 if a leg doesn't move."""
    by = W.partitionBy("pair").orderBy("ts_ms")
    step = rows.select("pair", (F.col("x1") - F.lag("x1").over(by)).alias("r1"), (F.col("x2") - F.lag("x2").over(by)).alias("r2")).dropna()
    flat = (F.stddev_pop("r1") == 0) | (F.stddev_pop("r2") == 0)
    return step.groupBy("pair").agg(F.when(flat, 0.0).otherwise(F.corr("r1", "r2")).alias("return_corr"))


def coint_p(rows: DataFrame) -> DataFrame:
    """(pair, coint_pvalue): a regression a pair in numpy, pairs in parallel."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_ms")
        return pd.DataFrame({"pair": [key[0]], "coint_pvalue": pd.array([engle_granger_p(pdf.x1.to_numpy(), pdf.x2.to_numpy())], dtype="Float64")})

    return rows.groupBy("pair").applyInPandas(run, "pair string, coint_pvalue double")


def pair_statistics(closes: DataFrame, pairs: DataFrame, bar_minutes: int, least: int = 200) -> DataFrame:
    """All statistics of the pairs with enough common rows."""
    rows = log_pairs(closes, pairs)
    fits = hedges(rows).where(F.col("n") >= least)
    kept = rows.join(fits.select("pair"), "pair", "left_semi")
    return pairs.join(fits, "pair").join(half_life(kept, fits, bar_minutes), "pair").join(return_corr(kept), "pair").join(coint_p(kept), "pair").where("coint_pvalue IS NOT NULL")


def choose_pairs(stats: DataFrame, top_k: int = 10, per_asset: int = 2, max_p: float = 0.05, min_half_life: float = 60.0, max_half_life: float = 4320.0, min_corr: float = 0.3) -> DataFrame:
    """Greedy choice by (p, asset1, asset2) with so many pairs an asset at most; rank starts at 0.

    Pairs are numbered in order in Spark; the driver reads them part by part and stops with the top_k-th choice.
    """
    fit = stats.where((F.col("beta") > 0) & (F.col("coint_pvalue") <= max_p) & F.col("half_life_minutes").between(min_half_life, max_half_life) & (F.col("return_corr") >= min_corr))
    used: Counter = Counter()
    chosen: list[tuple[int, str]] = []
    for r in fit.select("coint_pvalue", "asset1", "asset2", "pair").orderBy("coint_pvalue", "asset1", "asset2").toLocalIterator():
        if len(chosen) == top_k:
            break
        if max(used[r.asset1], used[r.asset2]) < per_asset:
            chosen.append((len(chosen), r.pair))
            used.update((r.asset1, r.asset2))
    picked = stats.sparkSession.createDataFrame(chosen, "rank int, pair string")  # top_k rows at most
    return picked.join(fit, "pair").select("rank", *stats.columns)
