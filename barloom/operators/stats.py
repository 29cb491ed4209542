"""Statistics of return series and trades as grouped aggregates."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import bucket, product_of_growth, ratio
from ..functions.normal import deflated_sharpe, probabilistic_sharpe

YEAR = 365.0
#: Values of a group that one task draws from, and distinct values of a slice of a larger one.
RESAMPLED = 1 << 18


def sharpe(r: str = "ret", periods: float = YEAR):
    """Aggregate: annualized Sharpe ratio, 0 for fewer than two returns or none that differ."""
    return F.coalesce(F.when(F.stddev_samp(r) > 0, F.avg(r) / F.stddev_samp(r) * periods**0.5), F.lit(0.0))


def sortino(r: str = "ret", periods: float = YEAR):
    """Aggregate: mean over the root mean square of the losses, taken over all returns."""
    down = F.sqrt(F.avg(F.pow(F.least(F.col(r), F.lit(0.0)), F.lit(2.0))))
    return F.coalesce(F.when((F.count(r) >= 2) & (down > 0), F.avg(r) / down * periods**0.5), F.lit(0.0))


def moments(rows: DataFrame, keys: tuple[str, ...], r: str = "ret") -> DataFrame:
    """n, mean, std (sample), skew and kurtosis (population, 3 for a normal) of each group."""
    own = rows.where(F.col(r).isNotNull())
    return own.groupBy(*keys).agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.skewness(r).alias("skew"), (F.kurtosis(r) + 3).alias("kurtosis"))


def against_chance(rows: DataFrame, keys: tuple[str, ...], n_trials: int = 1, r: str = "ret") -> DataFrame:
    """moments() with psr and dsr: the moments are Spark's, a row for each group goes through the normal distribution."""
    stats = moments(rows, keys, r)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields)

    def run(batches):
        for pdf in batches:
            psr, dsr = [], []
            for t in pdf.itertuples():
                flat = t.n < 3 or not t.std > 0
                shape = (0.0, 3.0) if flat else (t.skew, t.kurtosis)
                s = 0.0 if flat else t.mean / t.std
                psr.append(probabilistic_sharpe(s, t.n, *shape))
                dsr.append(0.0 if flat else deflated_sharpe(s, t.n, *shape, n_trials))
            yield pdf.assign(psr=psr, dsr=dsr)

    return stats.mapInPandas(run, f"{kinds}, psr double, dsr double")


def _sliced(rows: DataFrame, ts: str, slice_ms: int | None) -> DataFrame:
    """rows with _slice, the time slice of ts; a missing time comes before all others, as in a sort."""
    return rows.withColumn("_slice", F.lit(0) if slice_ms is None else F.coalesce(bucket(ts, slice_ms), F.lit(-(1 << 62))))


def _same(keys: tuple[str, ...]):
    """Rows a and b of the same keys; missing keys are a group of their own."""
    return reduce(lambda x, k: x & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")), keys, F.lit(True))


def _of_slices(rows: DataFrame, keys: tuple[str, ...], value, carried) -> DataFrame:
    """rows with _before, carried() over the slices before their own of value, an aggregate of each slice."""
    by = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    before = rows.groupBy(*keys, "_slice").agg(value.alias("_v")).select(*keys, "_slice", carried("_v").over(by).alias("_before"))  # a row for each slice
    return rows.alias("a").join(before.alias("b"), _same((*keys, "_slice"))).select("a.*", "b._before")


def drawdowns(points: DataFrame, keys: tuple[str, ...], order: str | tuple[str, ...], equity: str = "equity", start: float | None = None, slice_ms: int | None = None) -> DataFrame:
    """(keys, max_drawdown): the deepest fall from a peak, as a share of it; start is a peak before the first point.

    slice_ms cuts a long key into slices of that time of the first order column, and carries the peak from slice to slice.
    """
    order = (order,) if isinstance(order, str) else order
    by = W.partitionBy(*keys, "_slice").orderBy(*order).rangeBetween(W.unboundedPreceding, W.currentRow)
    own = _sliced(points, order[0], slice_ms)
    if slice_ms is None:
        own = own.withColumn("_before", F.lit(None).cast("double"))
    else:
        own = _of_slices(own, keys, F.max(equity), F.max)
    peak = F.greatest(F.max(equity).over(by), F.col("_before"), F.lit(start).cast("double"))
    return own.withColumn("_fall", ratio(peak - F.col(equity), peak)).groupBy(*keys).agg(F.greatest(F.max("_fall"), F.lit(0.0)).alias("max_drawdown"))


def running_equity(trades: DataFrame, keys: tuple[str, ...], start: float, order: tuple[str, ...] = ("exit_ts", "pair"), slice_ms: int | None = None) -> DataFrame:
    """trades with the equity after each; those that tie in all of order have the equity after the last of them.

    slice_ms cuts a long key into slices of that time of the first order column, and carries the sum from slice to slice.
    """
    by = W.partitionBy(*keys, "_slice").orderBy(*order).rangeBetween(W.unboundedPreceding, W.currentRow)
    own = _sliced(trades, order[0], slice_ms)
    total = F.sum("net_pnl").over(by)
    if slice_ms is not None:
        own = _of_slices(own, keys, F.sum("net_pnl"), F.sum)
        total = F.coalesce(F.col("_before") + total, "_before", total)
    return own.withColumn("equity", F.lit(start) + total).drop("_slice", "_before")


def _kinds(rows: DataFrame, keys: tuple[str, ...]) -> str:
    return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)


def _bootstrap(rows: DataFrame, keys: tuple[str, ...], r: str, draw) -> DataFrame:
    times = [c for c in ("day_ms", "d_idx", "exit_ts") if c in rows.columns]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values([*times, r])[r].dropna().to_numpy(float)
        return pd.DataFrame([[*key, *draw(x)]], columns=[*keys, "mean", "lower", "upper"])

    return rows.select(*dict.fromkeys([*keys, *times, r])).groupBy(*keys).applyInPandas(run, f"{_kinds(rows, keys)}, mean double, lower double, upper double")


def bootstrap_mean(rows: DataFrame, keys: tuple[str, ...], r: str = "ret", n_boot: int = 10_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(keys, mean, lower, upper): percentile interval of the mean from seeded resamples.

    A group of at most RESAMPLED values is drawn from in one task, in order of time. Larger ones are cut into slices of
    values: see _bootstrap_slices().
    """

    def draw(x: np.ndarray) -> tuple:
        if not len(x):
            return 0.0, 0.0, 0.0
        g, means = np.random.default_rng(seed), []
        piece = max(1, 2_000_000 // len(x))
        for k in range(0, n_boot, piece):
            means.append(x[g.integers(0, len(x), size=(min(piece, n_boot - k), len(x)))].mean(axis=1))
        return (x.mean(), *np.quantile(np.concatenate(means), [alpha / 2, 1 - alpha / 2]))

    held = rows.withColumn(r, F.when(~F.isnan(r), F.col(r)))
    counts = held.groupBy(*keys, r).agg(F.count(r).alias("_c"))  # equal values meet before the shuffle
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.count(r).alias("_distinct"))
    of = lambda own, kept: own.alias("a").join(F.broadcast(sizes.where(kept)).alias("b"), _same(keys))  # noqa: E731  # a row for each group
    few = _bootstrap(of(held, F.col("_n") <= RESAMPLED).select("a.*"), keys, r, draw)
    many = of(counts, F.col("_n") > RESAMPLED).where(F.col(r).isNotNull()).select(*[f"a.{c}" for c in keys], F.col(r).cast("double").alias("_x"), "_c", "_n", "_distinct")
    return few.unionByName(_bootstrap_slices(many, keys, n_boot, seed, alpha))


def _bootstrap_slices(counts: DataFrame, keys: tuple[str, ...], n_boot: int, seed: int, alpha: float) -> DataFrame:
    """The same interval of large groups: counts has each value _x once with its count _c, the group's _n and _distinct.

    Values are dealt to slices by their hash. A resample of n values takes a multinomial number of them from each slice, and then
    that many from the slice's own values: the same distribution as n draws from all, and no task holds more than a slice.
    """
    sliced = counts.withColumn("_slice", F.pmod(F.xxhash64("_x"), F.ceil(F.col("_distinct") / RESAMPLED)))
    kinds = _kinds(counts, keys)
    by = [*keys, "_slice"]

    def deal(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_slice")
        weights = pdf["_w"].to_numpy(np.int64)
        taken = np.random.default_rng([seed, 0]).multinomial(weights.sum(), weights / weights.sum(), size=n_boot)
        return pdf[by].assign(_taken=list(taken.T))

    def draw(key: tuple, pdf: pd.DataFrame, taken: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_x")
        x, c = pdf["_x"].to_numpy(float), pdf["_c"].to_numpy(np.int64)
        g, ends, sums = np.random.default_rng([seed, 1 + int(pdf["_slice"].iloc[0])]), np.cumsum(c), np.empty(n_boot)
        for k, m in enumerate(taken["_taken"].iloc[0]):
            if 8 * len(x) <= ends[-1]:  # few values, each many times
                sums[k] = g.multinomial(m, c / ends[-1]) @ x
            else:
                at = g.integers(0, ends[-1], m)
                sums[k] = x[at if ends[-1] == len(x) else np.searchsorted(ends, at, side="right")].sum()
        return pdf[by][:1].assign(_total=float(c @ x), _n=int(ends[-1]), _sums=[sums])

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_slice")
        n, means = pdf["_n"].sum(), np.add.reduce(pdf["_sums"].to_list()) / pdf["_n"].sum()
        return pdf[list(keys)][:1].assign(mean=pdf["_total"].sum() / n).assign(**dict(zip(("lower", "upper"), np.quantile(means, [alpha / 2, 1 - alpha / 2]))))

    weights = sliced.groupBy(*by).agg(F.sum("_c").alias("_w"))  # a row for each slice, as in all that follows
    dealt = weights.groupBy(*keys).applyInPandas(deal, f"{kinds}, _slice long, _taken array<long>")
    own = sliced.select(*by, "_x", "_c").groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(draw, f"{kinds}, _slice long, _total double, _n long, _sums array<double>")
    return own.groupBy(*keys).applyInPandas(gather, f"{kinds}, mean double, lower double, upper double")


def block_bootstrap_mean(rows: DataFrame, keys: tuple[str, ...], r: str = "ret", block: int = 10, n_boot: int = 5000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """The same from moving blocks, which keep short memory; no interval below two blocks of returns."""

    def draw(x: np.ndarray) -> tuple:
        n = len(x)
        if n < 2 * block:
            return (x.mean() if n else 0.0), None, None
        blocks, g, means = -(-n // block), np.random.default_rng(seed), []
        sums, rest = np.concatenate([[0.0], np.cumsum(x)]), n - (-(-n // block) - 1) * block
        piece = max(1, 2_000_000 // blocks)
        for k in range(0, n_boot, piece):
            starts = g.integers(0, n - block + 1, size=(min(piece, n_boot - k), blocks))
            means.append(((sums[starts[:, :-1] + block] - sums[starts[:, :-1]]).sum(axis=1) + sums[starts[:, -1] + rest] - sums[starts[:, -1]]) / n)
        return (x.mean(), *np.quantile(np.concatenate(means), [alpha / 2, 1 - alpha / 2]))

    return _bootstrap(rows, keys, r, draw)


def trade_summary(trades: DataFrame, keys: tuple[str, ...], start_equity: float) -> DataFrame:
    """Headline numbers of accepted trades, with the count of each exit reason."""
    reasons = trades.groupBy(*keys, "exit_reason").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("exit_reason", "_n")))).alias("exit_reasons"))
    own = trades.groupBy(*keys).agg(
        F.count("*").alias("n_trades"), F.sum("net_pnl").alias("net_pnl"), (F.sum("net_pnl") / start_equity).alias("total_return"), F.sum("gross_pnl").alias("gross_pnl"),
        F.sum("execution_cost").alias("execution_cost"), F.sum("funding_cost").alias("funding_cost"), F.avg((F.col("net_pnl") > 0).cast("double")).alias("win_rate"),
        (F.avg("gross_ret") * 1e4).alias("mean_gross_ret_bp"), (F.avg("net_ret") * 1e4).alias("mean_net_ret_bp"), F.percentile("hold_minutes", F.lit(0.5)).alias("median_hold_minutes"),
    )
    return own.join(reasons, list(keys))


def maker_shares(trades: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Shares of legs filled as maker, and of trades with both legs so, at entry and exit."""
    one = lambda c: F.col(c).cast("double")
    out = {}
    for side in ("entry", "exit"):
        a, b = f"{side}_maker1", f"{side}_maker2"
        out |= {f"{side}_share": F.avg((one(a) + one(b)) / 2), f"{side}_both": F.avg((F.col(a) & F.col(b)).cast("double"))}
    return trades.groupBy(*keys).agg(*[v.alias(k) for k, v in out.items()])


def run_summary(trades: DataFrame, daily: DataFrame, keys: tuple[str, ...], start_equity: float, n_trials: int = 1, n_boot: int = 10_000, order: tuple[str, ...] = ("exit_ts", "pair"), slice_ms: int | None = None) -> DataFrame:
    """A run's whole summary: trade_summary() with the interval of the mean net return in bp, drawdown, and the ratios of its days.

    daily: (keys, day_ms, ret) of every day of the run. A run without trades has zeros. slice_ms cuts long runs as in drawdowns().
    """
    own = trade_summary(trades, keys, start_equity)
    fall = drawdowns(running_equity(trades, keys, start_equity, order, slice_ms), keys, order, start=start_equity, slice_ms=slice_ms)
    ci = bootstrap_mean(trades, keys, "net_ret", n_boot).select(*keys, (F.col("lower") * 1e4).alias("ci_lower_bp"), (F.col("upper") * 1e4).alias("ci_upper_bp"))
    chance = against_chance(daily, keys, n_trials).select(*keys, F.col("n").alias("n_days"), "psr", "dsr")
    ratios = daily.where("ret IS NOT NULL").groupBy(*keys).agg(sharpe().alias("sharpe"), sortino().alias("sortino"))
    out = chance.join(ratios, list(keys))
    for more in (own, fall, ci):
        out = out.join(more, list(keys), "left")
    return out.fillna(0).withColumn("n_trials_for_dsr", F.lit(n_trials))


def running_product(keys: tuple[str, ...], order: str, r: str):
    """The product of 1 + r up to each row; 0 from the first return of -100 % or less on."""
    by = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    grown = 1 + F.col(r)
    return F.when(F.min(grown).over(by) <= 0, 0.0).otherwise(F.exp(F.sum(F.when(grown > 0, F.ln(grown))).over(by)))


def daily_summary(days: DataFrame, keys: tuple[str, ...] = ("label",), n_trials: int = 1, intervals: bool = True) -> DataFrame:
    """Totals of daily results: compounded return, CAGR, ratios, drawdown, mean in bp with its block interval, turnover a year, exposure, costs."""
    total = product_of_growth("net")
    own = days.groupBy(*keys).agg(
        F.count("*").alias("n_days"), (total - 1).alias("total_return"), F.when(total > 0, F.pow(total, YEAR / F.count("*")) - 1).otherwise(-1.0).alias("cagr"),
        sharpe("net").alias("sharpe"), sortino("net").alias("sortino"), (F.avg("net") * 1e4).alias("mean_daily_bp"), (F.avg("turnover") * YEAR).alias("turnover_per_year"), F.avg("exposure").alias("avg_exposure"),
        F.sum("gross").alias("gross"), F.sum("cost").alias("cost"), F.sum("funding").alias("funding"),
    )
    fall = drawdowns(days.withColumn("equity", running_product(keys, "day_ms", "net")), keys, "day_ms", start=1.0)
    out = own.join(fall, list(keys)).join(against_chance(days, keys, n_trials, "net").select(*keys, "dsr"), list(keys))
    if intervals:
        ci = block_bootstrap_mean(days, keys, "net").select(*keys, (F.col("lower") * 1e4).alias("ci_lower_bp"), (F.col("upper") * 1e4).alias("ci_upper_bp"))
        out = out.join(ci, list(keys))
    return out.withColumn("n_trials_for_dsr", F.lit(n_trials))


def excess_return(days: DataFrame, bills: DataFrame, keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """(keys, total_return, bill_return, excess): compounded returns of days (day_ms, net) and of bills (day_ms, rate).

    excess is what a unit held in the strategy is worth in units held in bills, less one.
    """
    both = days.join(bills.select("day_ms", "rate"), "day_ms", "left").fillna(0.0, ["rate"])
    own = both.groupBy(*keys).agg((product_of_growth("net") - 1).alias("total_return"), (product_of_growth("rate") - 1).alias("bill_return"))
    return own.withColumn("excess", ratio(1 + F.col("total_return"), 1 + F.col("bill_return")) - 1)


def across_seeds(runs: DataFrame, by: str, value: str) -> DataFrame:
    return runs.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg((F.col(value) > 0).cast("double")).alias("share_positive"))


def correlations(days: DataFrame, label: str = "label", value: str = "net", on: str = "day_ms") -> DataFrame:
    """(a, b, corr, n) of every two labels over their common days; labels are few, days aren't."""
    a = days.select(on, F.col(label).alias("a"), F.col(value).alias("x"))
    b = days.select(on, F.col(label).alias("b"), F.col(value).alias("y"))
    return a.join(b, on).where("a < b").groupBy("a", "b").agg(F.round(F.corr("x", "y"), 3).alias("corr"), F.count("*").alias("n"))


def permutation_p(sims: DataFrame, real: DataFrame, keys: tuple[str, ...], value: str = "net_pnl") -> DataFrame:
    """(keys, n_sims, p_value): the share of simulations at least as good, the real run counted in."""
    both = sims.join(real.select(*keys, F.col(value).alias("_real")), list(keys))
    better = F.sum((F.col(value) >= F.col("_real")).cast("long"))
    return both.groupBy(*keys).agg(F.count("*").alias("n_sims"), F.avg(value).alias("sim_mean"), F.stddev_pop(value).alias("sim_std"), ((better + 1) / (F.count("*") + 1)).alias("p_value"))


def listing_days(daily: DataFrame) -> DataFrame:
    """(symbol, first_ms): the first day with volume."""
    return daily.where("quote_volume > 0").groupBy("symbol").agg(F.min("ts_ms").alias("first_ms"))


def exit_counts(trades: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return trades.groupBy(*keys, "exit_reason").agg(F.count("*").alias("n"))
