"""Writers: Parquet tables partitioned by symbol, text results, and the held-positions line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder for each symbol, sorted by time inside, so that scans prune both."""
    bars.repartition("symbol").sortWithinPartitions("symbol", "ts_ms").write.mode(mode).partitionBy("symbol").parquet(path)


def write_results(rows: DataFrame, path: str, kind: str = "json") -> None:
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def held_positions(weights: str | Column = "weights") -> Column:
    """`sym:+0.1234;...` of an array of (symbol, w), by symbol, without zeros."""
    own = F.sort_array(F.filter(F.col(weights) if isinstance(weights, str) else weights, lambda x: x["w"] != 0))
    return F.array_join(F.transform(own, lambda x: F.format_string("%s:%+.4f", x["symbol"], x["w"])), ";")
