"""As-of lookups and interval sums without a theta join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import bucket


def asof(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], ts: str = "ts_ms", strict: bool = False, order: Column | None = None, slice_ms: int | None = None) -> DataFrame:
    """Each left row with the values of the last right row at or before (strict: before) its time.

    One shuffle by key and one sort: both sides in one stream, the last right row carried along it. Of
    right rows at one time the one with the highest order holds. slice_ms cuts a long key into slices of
    that time: each slice is a task's group of its own, and only the last right row of each slice is
    carried from slice to slice, so that a key that holds a third of all rows is no straggler.
    """
    side = F.lit(1 if strict else 0)
    other = F.lit(0 if strict else 1)
    cells = [c for c in left.columns if c not in keys and c != ts]
    a = left.select(*keys, F.col(ts), F.struct(*(cells or [F.lit(0).alias("_none")])).alias("_left"), F.lit(None).alias("_right"), other.alias("_side"), F.lit(None).alias("_order"))
    rank = order if order is not None else F.lit(0)
    b = right.select(*keys, F.col(ts), F.lit(None).alias("_left"), F.struct(*values).alias("_right"), side.alias("_side"), rank.alias("_order"))
    rows = a.unionByName(b)
    by = list(keys)
    if slice_ms is not None:
        rows = rows.withColumn("_slice", bucket(ts, slice_ms))
        by.append("_slice")
    along = W.partitionBy(*by).orderBy(ts, "_side", "_order").rowsBetween(W.unboundedPreceding, 0)
    seen = rows.withColumn("_seen", F.last("_right", ignorenulls=True).over(along)).where("_left IS NOT NULL")
    if slice_ms is not None:
        ends = rows.groupBy(*by).agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.struct(F.col(ts), F.col("_order")))).alias("_end"))
        before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
        carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
        seen = seen.join(carried, by).withColumn("_seen", F.coalesce("_seen", "_carried"))
    return seen.select(*keys, ts, *[F.col(f"_left.{c}").alias(c) for c in cells], *[F.col(f"_seen.{v}").alias(v) for v in values])


def running_sums(events: DataFrame, keys: list[str], ts: str, value: str, slice_ms: int | None = None) -> DataFrame:
    """(keys, ts, _sum): the sum up to each time; slice_ms sums slice by slice and carries the slices' totals."""
    own = events.groupBy(*keys, ts).agg(F.sum(value).alias("_v"))
    if slice_ms is None:
        return own.select(*keys, ts, F.sum("_v").over(W.partitionBy(*keys).orderBy(ts).rowsBetween(W.unboundedPreceding, 0)).alias("_sum"))
    by = [*keys, "_slice"]
    own = own.withColumn("_slice", bucket(ts, slice_ms))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    totals = own.groupBy(*by).agg(F.sum("_v").alias("_v")).select(*by, F.coalesce(F.sum("_v").over(before), F.lit(0.0)).alias("_before"))  # a row for each slice
    inside = own.withColumn("_in", F.sum("_v").over(W.partitionBy(*by).orderBy(ts).rowsBetween(W.unboundedPreceding, 0)))
    return inside.join(totals, by).select(*keys, ts, (F.col("_before") + F.col("_in")).alias("_sum"))


def interval_sum(spans: DataFrame, events: DataFrame, keys: list[str], start: str, end: str, ts: str, value: str, name: str, slice_ms: int | None = None) -> DataFrame:
    """Sum of the events' values with start < ts <= end for each span: running sums looked up at both ends.

    slice_ms cuts long keys into time slices, for the sums and for the lookups.
    """
    sums = running_sums(events, keys, ts, value, slice_ms).withColumnRenamed(ts, "_at")
    out = spans
    for at, label in ((start, "_from"), (end, "_to")):
        found = asof(out.withColumn("_at", F.col(at)), sums, keys, ["_sum"], ts="_at", slice_ms=slice_ms).drop("_at")
        out = found.withColumnRenamed("_sum", label)
    return out.withColumn(name, F.when(F.col(end) > F.col(start), F.coalesce("_to", F.lit(0.0)) - F.coalesce("_from", F.lit(0.0))).otherwise(0.0)).drop("_from", "_to")
