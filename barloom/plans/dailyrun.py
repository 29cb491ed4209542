"""The driver of daily strategies: the account, its benchmarks, the hurdle, random signals, and combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.costs import CostModel
from ..operators import stats as T
from ..operators.daily import run_daily
from ..operators.weights import permuted

_SUMS = ("net", "gross", "cost", "funding", "turnover", "exposure")


def long_only(panel: DataFrame, symbol: str, label: str = "btc_long") -> DataFrame:
    """All equity in one symbol, every day."""
    return panel.where(F.col("symbol") == symbol).select(F.lit(label).alias("label"), "d_idx", "symbol", F.lit(1.0).alias("w"))


def equal_weight(panel: DataFrame, eligible: DataFrame | None = None, label: str = "equal_weight") -> DataFrame:
    """The same share in every eligible symbol of a day, or in all that trade."""
    own = (panel.where("close IS NOT NULL") if eligible is None else eligible).select("d_idx", "symbol")
    n = own.groupBy("d_idx").agg(F.count("*").alias("_n"))
    return own.join(n, "d_idx").select(F.lit(label).alias("label"), "d_idx", "symbol", (1 / F.col("_n")).alias("w"))


def with_benchmarks(panel: DataFrame, weights: DataFrame, rebalance: DataFrame | None, btc: str, eligible: DataFrame | None = None, costs: CostModel = CostModel(), **more) -> DataFrame:
    """Daily results of a strategy (label, d_idx, symbol, w), of holding one symbol, and of equal weights."""
    own = run_daily(panel, weights, rebalance, costs, **more)
    both = long_only(panel, btc).unionByName(equal_weight(panel, eligible))
    return own.unionByName(run_daily(panel, both, None, costs))


def random_signals(panel: DataFrame, weights: DataFrame, rebalance: DataFrame | None, eligible: DataFrame, n_sims: int, label: str, costs: CostModel = CostModel(), **more) -> DataFrame:
    """(label, n_sims, sim_mean, sim_std, p_value): the strategy's Sharpe ratio among those of its weights dealt at random.

    All simulations are labels of one account plan, so they run in parallel.
    """
    days = weights.select("d_idx").distinct()
    sims = eligible.join(days, "d_idx", "left_semi").withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1))))
    name = F.format_string("sim %d", F.col("sim"))
    dealt = permuted(weights, sims, F.col("sim"), ("sim",)).select(name.alias("label"), "d_idx", "symbol", "w")
    reb = None if rebalance is None else rebalance.select("d_idx").distinct().withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1)))).select(name.alias("label"), "d_idx")
    ratio = lambda r: r.groupBy("label").agg(T.sharpe("net").alias("sharpe"))
    real = ratio(run_daily(panel, weights, rebalance, costs, **more))
    named = lambda r: r.select(F.lit(label).alias("label"), "sharpe")
    return T.permutation_p(named(ratio(run_daily(panel, dealt, reb, costs, **more))), named(real), ("label",), "sharpe")


def combined(results: DataFrame, labels: tuple[str, ...], label: str = "combo") -> DataFrame:
    """Fixed equal parts of the capital in several strategies: the mean of their daily rows."""
    own = results.where(F.col("label").isin(*labels)).groupBy("d_idx", "day_ms").agg(*[(F.sum(c) / len(labels)).alias(c) for c in _SUMS])
    return own.select(F.lit(label).alias("label"), "d_idx", "day_ms", *_SUMS)


def summary(results: DataFrame, bills: DataFrame | None = None, n_trials: int = 1, intervals: bool = True) -> DataFrame:
    """daily_summary() of every label, with its return in excess of bills (day_ms, rate) if there are any."""
    out = T.daily_summary(results, ("label",), n_trials, intervals)
    if bills is not None:
        out = out.join(T.excess_return(results, bills).select("label", "bill_return", "excess"), "label")
    return out
