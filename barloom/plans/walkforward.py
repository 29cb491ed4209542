"""Walk-forward windows and the baseline strategy as one plan from bars to candidate trades."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import DAY_MS, MINUTE_MS, bars_in, log
from ..operators import bars as B
from ..operators.features import crossing, zscore
from ..operators.pairs import half_life, hedges, log_pairs
from ..operators.simulate import ExitRules, simulate

WINDOW = "index int, train_start long, train_end long, test_start long, test_end long"


def windows(data_start: int, data_end: int, train_days: int = 90, test_days: int = 30, holdout_days: int = 90) -> list[tuple[int, int, int, int, int]]:
    """Rolling half-open windows before the holdout; the last may be short, but not below a day."""
    end = data_end - holdout_days * DAY_MS
    n = max(0, math.ceil((end - data_start - train_days * DAY_MS) / (test_days * DAY_MS)))
    out = []
    for k in range(n):
        start = data_start + k * test_days * DAY_MS
        split = start + train_days * DAY_MS
        stop = min(split + test_days * DAY_MS, end)
        if stop - split >= DAY_MS:
            out.append((k, start, split, split, stop))
    return out


def windows_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, WINDOW)


@dataclass(frozen=True)
class Baseline:
    bar_minutes: int = 5
    z_minutes: int = 1440
    entry_z: float = 2.0
    half_lives: float = 3.0
    max_days: float = 3.0
    rules: ExitRules = ExitRules()


def in_windows(bars: DataFrame, spans: list[tuple[int, int, int]]) -> DataFrame:
    """Each bar once for every span (index, from, to) that holds it, its symbol marked with the index.

    The spans are literals, so all windows share one scan, and the operators by symbol or pair run over all of them at once.
    """
    every = F.array(*[F.struct(F.lit(k).alias("index"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for k, lo, hi in spans])
    own = time_limits(bars, spans).withColumn("_w", F.explode(F.filter(every, lambda w: (F.col("ts_ms") >= w["lo"]) & (F.col("ts_ms") < w["hi"]))))
    return own.withColumn("symbol", marked(F.col("_w.index"), "symbol")).drop("_w")


def time_limits(bars: DataFrame, spans: list[tuple[int, int, int]]) -> DataFrame:
    return B.time_slice(bars, min(lo for _, lo, _ in spans), max(hi for _, _, hi in spans))


def marked(index, name: str):
    return F.concat(index.cast("string"), F.lit("|"), F.col(name))


def of_windows(pairs: DataFrame, rows: list[tuple]) -> DataFrame:
    """(index, start_ms, pair, asset1, asset2): the pairs of every window under its marks."""
    each = F.explode(F.array(*[F.struct(F.lit(w[0]).alias("index"), F.lit(w[3]).cast("long").alias("start_ms")) for w in rows]))
    own = pairs.select("pair", "asset1", "asset2", each.alias("_w"))
    return own.select("_w.index", "_w.start_ms", *[marked(F.col("_w.index"), c).alias(c) for c in ("pair", "asset1", "asset2")])


def prepare(bars: DataFrame, pairs: DataFrame, start_ms: int, end_ms: int, bar_minutes: int, z_minutes: int, warmup_minutes: int) -> DataFrame:
    """Resampled and aligned bars of the pairs from the warm-up on, with spread, z and in_window.

    Rows before start_ms only feed the rolling window. The time filter stands on the scan's own column.
    """
    own = B.time_slice(bars, start_ms - warmup_minutes * MINUTE_MS, end_ms)
    return prepare_marked(own, pairs.withColumn("start_ms", F.lit(start_ms).cast("long")), bar_minutes, z_minutes)


def prepare_marked(bars: DataFrame, pairs: DataFrame, bar_minutes: int, z_minutes: int) -> DataFrame:
    """The same for pairs that carry their own start_ms, over bars that hold each pair's warm-up and window."""
    rows = B.align(B.resample(bars, bar_minutes), pairs, carry=("alpha", "beta", "half_life_minutes", "start_ms"))
    rows = rows.withColumn("spread", log("close1") - F.col("beta") * log("close2") - F.col("alpha"))
    return rows.withColumns({"z": zscore("spread", ["pair"], "ts_ms", max(2, bars_in(z_minutes, bar_minutes))), "in_window": F.col("ts_ms") >= F.col("start_ms")}).drop("start_ms")


def _entries(rows: DataFrame, cfg: Baseline) -> DataFrame:
    hold = F.least(F.col("half_life_minutes") * cfg.half_lives, F.lit(cfg.max_days * 1440.0)) / cfg.bar_minutes
    return rows.withColumns({"signal": crossing("z", ["pair"], "ts_ms", cfg.entry_z), "max_hold_bars": F.greatest(F.lit(1), F.floor(hold)).cast("int")})


def baseline_trades(bars: DataFrame, pairs: DataFrame, start_ms: int, end_ms: int, cfg: Baseline = Baseline()) -> DataFrame:
    """Candidate trades of mean reversion: fresh crosses, a time stop of some half-lives, at most some days."""
    return simulate(_entries(prepare(bars, pairs, start_ms, end_ms, cfg.bar_minutes, cfg.z_minutes, 2 * cfg.z_minutes), cfg), cfg.rules)


def baseline_walk(bars: DataFrame, pairs: DataFrame, rows: list[tuple], cfg: Baseline = Baseline()) -> DataFrame:
    """Trades of all windows with their window: hedges and half-lives from each training span, trades in its test span.

    One plan for all windows: two scans of the bars, and every group is a window's pair.
    """
    own = of_windows(pairs, rows)
    closes = log_pairs(in_windows(bars, [(k, a, b) for k, a, b, _, _ in rows]), own)
    fits = hedges(closes)
    full = own.join(fits, "pair").join(half_life(closes, fits, cfg.bar_minutes), "pair").select("pair", "asset1", "asset2", "start_ms", "alpha", "beta", "half_life_minutes")
    tested = in_windows(bars, [(k, c - 2 * cfg.z_minutes * MINUTE_MS, d) for k, _, _, c, d in rows])
    trades = simulate(_entries(prepare_marked(tested, full, cfg.bar_minutes, cfg.z_minutes), cfg), cfg.rules)
    return trades.withColumns({"window": F.split("pair", r"\|")[0].cast("int"), "pair": F.split("pair", r"\|")[1]})
