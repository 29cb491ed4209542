"""Bars: dedupe, slices, validation, resampling and alignment of legs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import DAY_MS, HOUR_MS, MINUTE_MS, bucket, day_of


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the one with the highest order: an aggregate, so nothing is sorted and copies meet before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def time_slice(rows: DataFrame, start_ms: int, end_ms: int, ts: str = "ts_ms") -> DataFrame:
    """Rows of [start, end); a plain filter on the time column, so it reaches the scan."""
    return rows.where((F.col(ts) >= start_ms) & (F.col(ts) < end_ms))


def traded(rows: DataFrame, volume: str = "volume") -> DataFrame:
    return rows.where(F.col(volume) > 0)


def gaps(rows: DataFrame, order: str, slice_ms: int, name: str) -> DataFrame:
    """rows with the step of `order` from the symbol's row before, slice by slice: each slice's last value is carried to the next."""
    by = ["symbol", "_slice"]
    sliced = rows.withColumn("_slice", F.floor(F.col(order) / slice_ms))
    ends = sliced.groupBy(*by).agg(F.max(order).alias("_end"))
    ends = ends.select(*by, F.lag("_end").over(W.partitionBy("symbol").orderBy("_slice")).alias("_carried"))  # a row for each slice
    inside = sliced.withColumn("_last", F.lag(order).over(W.partitionBy(*by).orderBy(order))).join(ends, by)
    return inside.withColumn(name, F.col(order) - F.coalesce("_last", "_carried")).drop("_slice", "_last", "_carried")


def validate(bars: DataFrame, bar_minutes: int = 1, seq: str | None = None, slice_ms: int = 30 * DAY_MS) -> DataFrame:
    """A row for each symbol: rows, duplicates, unsorted, bad_ohlc, non_positive, gaps, largest_gap_min, ok.

    Unsorted rows are those earlier than the row before in seq, a column in which the rows of a symbol were written
    one after the other. Gaps don't make a symbol bad. A symbol's history is cut into slices of time, and of seq.
    """
    step = bar_minutes * MINUTE_MS
    bad = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    low = F.least("open", "high", "low", "close") <= 0
    seen = gaps(bars, "ts_ms", slice_ms, "_gap")
    out = seen.groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.sum((F.col("_gap") == 0).cast("int")).alias("duplicates"),
        F.sum(bad.cast("int")).alias("bad_ohlc"), F.sum(low.cast("int")).alias("non_positive"),
        F.sum((F.col("_gap") > step).cast("int")).alias("gaps"), F.max(F.col("_gap") / MINUTE_MS).alias("largest_gap_min"),
    )
    out = out.join(unsorted_rows(bars, seq), "symbol", "left") if seq is not None else out.withColumn("unsorted", F.lit(0))
    out = out.fillna(0, ["duplicates", "unsorted", "bad_ohlc", "non_positive", "gaps", "largest_gap_min"])
    return out.withColumn("ok", F.expr("duplicates = 0 AND unsorted = 0 AND bad_ohlc = 0 AND non_positive = 0"))


def unsorted_rows(bars: DataFrame, seq: str, size: int = 1 << 20) -> DataFrame:
    """(symbol, unsorted): rows earlier than the symbol's row before in seq, by slices of seq with their last time carried on."""
    by = ["symbol", "_slice"]
    rows = bars.select("symbol", "ts_ms", F.col(seq).alias("_seq"), F.floor(F.col(seq) / size).alias("_slice"))
    ends = rows.groupBy(*by).agg(F.max_by("ts_ms", "_seq").alias("_end"))
    ends = ends.select(*by, F.lag("_end").over(W.partitionBy("symbol").orderBy("_slice")).alias("_carried"))  # a row for each slice
    last = F.coalesce(F.lag("ts_ms").over(W.partitionBy(*by).orderBy("_seq")), F.col("_carried"))
    seen = rows.join(ends, by).withColumn("_back", F.col("ts_ms") < last)
    return seen.groupBy("symbol").agg(F.coalesce(F.sum(F.col("_back").cast("int")), F.lit(0)).alias("unsorted"))


def resample(bars: DataFrame, bar_minutes: int) -> DataFrame:
    """Bars of so many minutes: first open, highest high, lowest low, last close, summed volumes, n_minutes."""
    if bar_minutes == 1:
        return bars.withColumn("n_minutes", F.lit(1).cast("bigint"))
    slot = bucket("ts_ms", bar_minutes * MINUTE_MS)
    return bars.groupBy("symbol", slot.alias("_slot")).agg(
        F.min_by("open", "ts_ms").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts_ms").alias("close"),
        F.sum("volume").alias("volume"), F.sum("taker_buy_volume").alias("taker_buy_volume"), F.count("*").alias("n_minutes"),
    ).withColumnRenamed("_slot", "ts_ms")


def ticks_to_bars(ticks: DataFrame, step_ms: int, order: tuple[str, ...] = ("ts_ms", "seq")) -> DataFrame:
    """OHLCV bars of (symbol, ts_ms, price, volume) ticks; ties in time go by the further order columns."""
    at = F.struct(*order)
    return ticks.groupBy("symbol", bucket("ts_ms", step_ms).alias("bar_ms")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"), F.count("*").alias("n_ticks"),
    ).withColumnRenamed("bar_ms", "ts_ms")


def daily_closes(bars: DataFrame) -> DataFrame:
    """(symbol, day_ms, close) of days that traded into their last hour."""
    days = bars.groupBy("symbol", day_of("ts_ms").alias("day_ms")).agg(F.max_by("close", "ts_ms").alias("close"), F.max("ts_ms").alias("_last"))
    return days.where(F.col("_last") >= F.col("day_ms") + DAY_MS - HOUR_MS).drop("_last")


def selection_closes(bars: DataFrame, start_ms: int, end_ms: int, bar_minutes: int) -> DataFrame:
    """(symbol, ts_ms, close): the last close of each selection bar of [start, end)."""
    own = time_slice(bars.select("symbol", "ts_ms", "close"), start_ms, end_ms)
    return own.groupBy("symbol", bucket("ts_ms", bar_minutes * MINUTE_MS).alias("slot")).agg(F.max_by("close", "ts_ms").alias("close")).withColumnRenamed("slot", "ts_ms")


def align(bars: DataFrame, pairs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both legs at the same time for each (pair, asset1, asset2): columns of the legs end in 1 and 2.

    pairs is a dimension table; each leg is joined by its symbol, so a bar goes only where a pair needs it.
    """
    values = [c for c in bars.columns if c not in ("symbol", "ts_ms")]
    legs = []
    for n in (1, 2):
        own = pairs.select("pair", F.col(f"asset{n}").alias("symbol"), *(carry if n == 1 else ()))
        legs.append(bars.join(own, "symbol").select("pair", "ts_ms", *(carry if n == 1 else ()), *[F.col(c).alias(f"{c}{n}") for c in values]))
    return legs[0].join(legs[1], ["pair", "ts_ms"])


def forward_fill_onto(rows: DataFrame, other: DataFrame, keys: list[str], ts: str, value: str, name: str) -> DataFrame:
    """Join other's value at equal times, then carry the last one forward along each key's rows.

    Only times that rows has are seen: a value between two rows is not.
    """
    joined = rows.join(other.select(F.col(ts), F.col(value).alias("_value")), ts, "left")
    return joined.withColumn(name, F.last("_value", ignorenulls=True).over(W.partitionBy(*keys).orderBy(ts).rowsBetween(W.unboundedPreceding, 0))).drop("_value")


def eligible_symbols(bars: DataFrame, windows: DataFrame, grace_days: int = 7) -> DataFrame:
    """(index, symbol): symbols that began by a week into the training span and still trade at the test's start."""
    seen = bars.groupBy("symbol").agg(F.min("ts_ms").alias("_first"), F.max("ts_ms").alias("_last"))
    return seen.join(F.broadcast(windows), (F.col("_first") <= F.col("train_start") + grace_days * DAY_MS) & (F.col("_last") >= F.col("test_start"))).select("index", "symbol")


def covered_until(funding: DataFrame, end_ms: int) -> DataFrame:
    """One row: the earliest of end_ms and the last funding event of any symbol."""
    last = funding.groupBy("symbol").agg(F.max("ts_ms").alias("last"))
    return last.agg(F.least(F.lit(end_ms), F.min("last")).alias("end_ms"))


def neutral_taker_volume(bars: DataFrame) -> DataFrame:
    """A missing taker volume counts as half the volume."""
    return bars.withColumn("taker_buy_volume", F.coalesce("taker_buy_volume", 0.5 * F.col("volume")))


def merge_sources(*frames: DataFrame, keys: tuple[str, ...] = ("symbol", "ts_ms")) -> DataFrame:
    """Union of file frames; of equal keys the row of the last frame holds."""
    rows = None
    for k, f in enumerate(frames):
        own = f.withColumn("_source", F.lit(k))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    return keep_last(rows, list(keys), "_source").drop("_source")


def prepend(history: DataFrame, actual: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts_ms") -> DataFrame:
    """History only before the first actual row of its key, then the actual rows."""
    first = actual.groupBy(*keys).agg(F.min(ts).alias("_first"))
    old = history.join(first, list(keys), "left").where(F.col("_first").isNull() | (F.col(ts) < F.col("_first"))).drop("_first")
    return old.unionByName(actual)
