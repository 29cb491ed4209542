"""Funding rates: days, payments, reconstruction and its validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import DAY_MS, HOUR_MS, clip, ratio
from .asof import interval_sum


def by_day(events: DataFrame) -> DataFrame:
    """(symbol, day_ms, funding, n): an event belongs to the day that ends at or after it, so 00:00 to the day before."""
    day = (F.ceil(F.col("ts_ms") / DAY_MS) - 1) * DAY_MS
    return events.groupBy("symbol", day.cast("bigint").alias("day_ms")).agg(F.sum("funding_rate").alias("funding"), F.count("*").alias("n"))


def payments(legs: DataFrame, events: DataFrame) -> DataFrame:
    """legs (symbol, sign, notional, entry_ts, exit_ts, ...) with funding_cost: a long pays positive rates."""
    paid = interval_sum(legs, events, ["symbol"], "entry_ts", "exit_ts", "ts_ms", "funding_rate", "_rates", 90 * DAY_MS)
    return paid.withColumn("funding_cost", F.col("sign") * F.abs("notional") * F.col("_rates")).drop("_rates")


def reconstruct(premium: DataFrame, interval_hours: int, least: float = 0.9) -> DataFrame:
    """Rates from one-minute premium closes (symbol, open_time, premium_close): (symbol, ts_ms, funding_rate, n).

    Within an interval later minutes weigh more: weights 1, 2, ... . An interval with less than this
    share of its minutes has no rate.
    """
    if 24 % interval_hours:
        raise ValueError(f"an interval of {interval_hours} hours does not divide a day")
    span = interval_hours * HOUR_MS
    end = F.col("open_time") - F.pmod("open_time", F.lit(span)) + span
    own = premium.select("symbol", end.alias("ts_ms"), "open_time", "premium_close")
    own = own.withColumn("w", F.row_number().over(W.partitionBy("symbol", "ts_ms").orderBy("open_time", "premium_close")))
    mean = own.groupBy("symbol", "ts_ms").agg(F.count("*").alias("n"), ratio(F.sum(F.col("w") * F.col("premium_close")), F.sum("w").cast("double")).alias("p"))
    base = 1e-4 * interval_hours / 8
    rate = F.col("p") + clip(base - F.col("p"), -5e-4, 5e-4)
    return mean.select("symbol", "ts_ms", F.when(F.col("n") >= least * interval_hours * 60, rate).alias("funding_rate"), "n")


def interval_hours(events: DataFrame) -> DataFrame:
    """(symbol, hours): the usual gap of the last ten events, if it is 1, 2, 4 or 8 hours; NULL otherwise."""
    latest = W.partitionBy("symbol").orderBy(F.desc("ts_ms"))
    tail = events.withColumns({"_k": F.row_number().over(latest), "_gap": F.lag("ts_ms").over(latest) - F.col("ts_ms")}).where("_k <= 10")
    out = tail.groupBy("symbol").agg(F.count("*").alias("_n"), F.bround(F.percentile("_gap", F.lit(0.5)) / HOUR_MS).cast("int").alias("_h"))
    return out.select("symbol", F.when((F.col("_n") >= 4) & F.col("_h").isin(1, 2, 4, 8), F.col("_h")).alias("hours"))


def from_candles(proxy: DataFrame, index: DataFrame, terms: DataFrame) -> DataFrame:
    """Hourly rates of a venue from proxy and index candles; terms: (symbol, k, cap). The rate settles an hour later."""
    mid = lambda f, n: f.select("symbol", "ts_ms", ((F.col("open") + F.col("close")) / 2).alias(n))
    both = mid(proxy, "p").join(mid(index, "i"), ["symbol", "ts_ms"]).where("i > 0").join(terms, "symbol")
    return both.select("symbol", (F.col("ts_ms") + HOUR_MS).alias("ts_ms"), clip((F.col("p") / F.col("i") - 1) / F.col("k"), -F.col("cap"), F.col("cap")).alias("funding_rate"))


def compare_days(actual: DataFrame, rebuilt: DataFrame, least: int = 20) -> DataFrame:
    """(symbol, day_ms, funding, funding_r) of days with enough events on both sides."""
    a, b = by_day(actual), by_day(rebuilt).select("symbol", "day_ms", F.col("funding").alias("funding_r"), F.col("n").alias("n_r"))
    return a.join(b, ["symbol", "day_ms"]).where((F.col("n") >= least) & (F.col("n_r") >= least)).select("symbol", "day_ms", "funding", "funding_r")


def entry_days(days: DataFrame, value: str, threshold: float = 0.0035, span: int = 7) -> DataFrame:
    """(symbol, day_ms) where the sum over so many consecutive days reaches the threshold."""
    w = W.partitionBy("symbol").orderBy("day_ms")
    total = F.sum(value).over(w.rowsBetween(-(span - 1), 0))
    whole = F.col("day_ms") - F.lag("day_ms", span - 1).over(w) == (span - 1) * DAY_MS
    return days.withColumns({"_total": total, "_whole": whole}).where(F.col("_whole") & (F.col("_total") >= threshold)).select("symbol", "day_ms")


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n_a, n_b, n_both, jaccard of two sets of equal columns; NULL for two empty sets."""
    marked = a.distinct().withColumn("_a", F.lit(1)).unionByName(b.distinct().withColumn("_b", F.lit(1)), allowMissingColumns=True)
    each = marked.groupBy(*a.columns).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    n = each.agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.sum((F.col("_a").isNotNull() & F.col("_b").isNotNull()).cast("long")).alias("n_both"), F.count("*").alias("_n"))
    return n.select("n_a", "n_b", F.coalesce("n_both", F.lit(0)).alias("n_both"), ratio(F.col("n_both").cast("double"), F.col("_n").cast("double")).alias("jaccard"))


def validate_proxies(days: DataFrame, min_corr: float = 0.9, min_jaccard: float = 0.8) -> DataFrame:
    """Over compare_days() rows with a proxy column: corr and jaccard of each proxy, chosen and passed."""
    stats = days.groupBy("proxy").agg(F.corr("funding", "funding_r").alias("corr"), F.count("*").alias("n_days"), F.countDistinct("symbol").alias("n_symbols"))
    keyed = days.withColumn("symbol", F.concat_ws("|", "proxy", "symbol"))
    a, r = (entry_days(keyed, v).withColumn("side", F.lit(v)) for v in ("funding", "funding_r"))
    each = a.unionByName(r).groupBy("symbol", "day_ms").agg(F.count("*").alias("n")).groupBy(F.split("symbol", r"\|")[0].alias("proxy")).agg(F.count("*").alias("n_any"), F.sum((F.col("n") == 2).cast("long")).alias("n_both"))
    out = stats.join(each, "proxy", "left").withColumn("jaccard", ratio(F.col("n_both").cast("double"), F.col("n_any").cast("double")))
    best = W.partitionBy(F.lit(1)).orderBy(F.desc("corr"), "proxy")  # a row for each proxy
    out = out.withColumn("chosen", F.row_number().over(best) == 1)
    return out.withColumn("passed", F.col("chosen") & (F.col("corr") >= min_corr) & F.coalesce(F.col("jaccard") >= min_jaccard, F.lit(False)))
