"""Daily panels in long form: a row for each day and symbol, NULL where there was no trading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import DAY_MS, last_rows, log
from .funding import by_day

SPOT = "SPOT:"


def spine(symbols: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """(d_idx, day_ms, symbol, s_idx) of all days of [start, end); symbols: (symbol, s_idx), a dimension table."""
    first, last = start_ms // DAY_MS * DAY_MS, end_ms // DAY_MS * DAY_MS
    days = F.explode(F.sequence(F.lit(0), F.lit(max(0, (last - first) // DAY_MS - 1))))
    if last <= first:
        return symbols.select(F.lit(0).alias("d_idx"), F.lit(first).cast("bigint").alias("day_ms"), "symbol", "s_idx").limit(0)
    return symbols.select("symbol", "s_idx", days.alias("d_idx")).select("d_idx", (F.lit(first) + F.col("d_idx").cast("bigint") * DAY_MS).alias("day_ms"), "symbol", "s_idx")


def numbered_symbols(rows: DataFrame) -> DataFrame:
    """(symbol, s_idx) in alphabetical order: a row for each symbol."""
    return rows.select("symbol").distinct().withColumn("s_idx", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("symbol")) - 1)


def symbol_union(*frames: DataFrame) -> DataFrame:
    """(symbol): every symbol of any frame once; each frame gives its own before they meet."""
    return reduce(DataFrame.unionByName, [f.select("symbol").distinct() for f in frames]).distinct()


def uncovered_months(days: DataFrame, covered: DataFrame) -> DataFrame:
    """(symbol, month): months with traded days (symbol, day_ms, quote_volume) that covered (symbol, month) lacks."""
    traded = days.where("quote_volume > 0").select("symbol", F.date_format(F.timestamp_millis("day_ms"), "yyyy-MM").alias("month")).distinct()
    return traded.join(covered.select("symbol", "month"), ["symbol", "month"], "left_anti")


def build_panel(daily: DataFrame, funding: DataFrame | None, start_ms: int, end_ms: int) -> DataFrame:
    """Panel of daily rows (symbol, ts_ms or day_ms, close[, quote_volume, high]); days without volume count as not traded."""
    if "day_ms" not in daily.columns:
        daily = daily.withColumnRenamed("ts_ms", "day_ms")
    if "quote_volume" in daily.columns:
        daily = daily.where("quote_volume > 0")
    own = [c for c in ("close", "quote_volume", "high") if c in daily.columns]
    out = spine(numbered_symbols(daily), start_ms, end_ms).join(daily.select("symbol", "day_ms", *own), ["symbol", "day_ms"], "left")
    if funding is not None:
        out = out.join(by_day(funding).select("symbol", "day_ms", "funding"), ["symbol", "day_ms"], "left")
    else:
        out = out.withColumn("funding", F.lit(0.0))
    for c in ("quote_volume", "high"):
        if c not in own:
            out = out.withColumn(c, F.lit(None).cast("double"))
    out = out.withColumns({"funding": F.coalesce("funding", F.lit(0.0)), "quote_volume": F.coalesce("quote_volume", F.lit(0.0))})
    return out.select("d_idx", "day_ms", "symbol", "s_idx", "close", "funding", "quote_volume", "high")


def add_spot(panel: DataFrame, spot: DataFrame) -> DataFrame:
    """Append SPOT:<symbol> rows for symbols of the panel that also trade spot; they have no funding."""
    names = panel.groupBy("symbol").agg(F.first("s_idx").alias("s_idx")).join(spot.select("symbol").distinct(), "symbol", "left_semi")
    width = panel.agg(F.max("s_idx").alias("_top"))
    order = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("symbol"))
    names = names.select("symbol", order.alias("_k")).join(F.broadcast(width)).select("symbol", (F.col("_top") + F.col("_k")).cast("int").alias("s_idx"))
    days = panel.select("d_idx", "day_ms").distinct()
    own = spot.where("quote_volume > 0").select("symbol", F.col("ts_ms").alias("day_ms"), "close", "quote_volume")
    rows = days.join(F.broadcast(names)).join(own, ["symbol", "day_ms"], "left")
    rows = rows.select("d_idx", "day_ms", F.concat(F.lit(SPOT), "symbol").alias("symbol"), "s_idx", "close", F.lit(0.0).alias("funding"), F.coalesce("quote_volume", F.lit(0.0)).alias("quote_volume"), F.lit(None).cast("double").alias("high"))
    return panel.unionByName(rows)


def spot_of(panel: DataFrame) -> DataFrame:
    """(symbol, spot): perpetuals with a spot column."""
    names = panel.select("symbol").distinct()
    spots = names.where(F.col("symbol").startswith(SPOT)).select(F.col("symbol").alias("spot"), F.expr(f"substring(symbol, {len(SPOT) + 1})").alias("symbol"))
    return names.join(spots, "symbol")


def _rows(n: int):
    return last_rows(["symbol"], "d_idx", n)


def live(n: int) -> Column:
    """Whether a symbol has a close on each of the last n days."""
    return F.count("close").over(_rows(n)) == n


def trailing_funding(n: int) -> Column:
    return F.sum("funding").over(_rows(n))


def average_volume(n: int) -> Column:
    return F.avg("quote_volume").over(_rows(n))


def daily_return() -> Column:
    return log("close") - F.lag(log("close")).over(W.partitionBy("symbol").orderBy("d_idx"))


def trailing_vol(returns: str, n: int) -> Column:
    """Sample deviation of the returns that exist in the last n days."""
    return F.stddev_samp(returns).over(_rows(n))


def liquid_universe(panel: DataFrame, top_n: int, min_history: int) -> DataFrame:
    """Rows of the top_n symbols of each day by average volume among those live for min_history days; adv_rank starts at 1."""
    seen = panel.withColumns({"_live": live(min_history), "adv": average_volume(min_history)}).where(F.col("_live") & (F.col("d_idx") >= min_history - 1)).drop("_live")
    rank = F.row_number().over(W.partitionBy("d_idx").orderBy(F.desc("adv"), "s_idx"))
    return seen.withColumn("adv_rank", rank).where(F.col("adv_rank") <= top_n)


def equity_by_day(points: DataFrame, start_ms: int, end_ms: int, start_equity: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(day_ms, equity, ret) of every day: the last realized equity (points: ts_ms, equity[, seq]) carried forward."""
    first, last = start_ms // DAY_MS, end_ms // DAY_MS
    day = F.floor(F.col("ts_ms") / DAY_MS)
    at = F.struct("ts_ms", "seq") if "seq" in points.columns else F.col("ts_ms")
    ends = points.groupBy(*keys, day.alias("_d")).agg(F.max_by("equity", at).alias("equity"))
    days = F.explode(F.sequence(F.lit(first), F.lit(last)))
    base = points.select(*keys).distinct() if keys else points.sparkSession.range(1).select()
    grid = base.select(*keys, days.alias("_d")).withColumn("_d", F.col("_d").cast("bigint"))
    by = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_d")
    out = grid.join(ends, [*keys, "_d"], "left").withColumn("equity", F.coalesce(F.last("equity", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0)), F.lit(start_equity)))
    before = F.coalesce(F.lag("equity").over(by), F.lit(start_equity))
    return out.select(*keys, (F.col("_d") * DAY_MS).alias("day_ms"), "equity", (F.col("equity") / before - 1).alias("ret"))
