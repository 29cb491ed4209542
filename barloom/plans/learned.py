"""The learned strategy window by window: fit, threshold choice on later validation days, trades on the test days."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MINUTE_MS
from ..functions.costs import CostModel
from ..operators import bars as B
from ..operators import features as X
from ..operators import learn as L
from ..operators import pairs as P
from ..operators.simulate import Execution, ExitRules, simulate
from .walkforward import marked

#: What a candidate carries for the meta filter.
META = ("abs_z", "edge", "unc", "spread_vol_ratio", "adf_pvalue_24h", "half_life_hours")
INFO = ("pred_ret", *META)


@dataclass(frozen=True)
class Plan:
    """horizon of cfg is in bars; meta: the info columns of the filter, none without one."""

    cfg: L.LearnConfig = field(default_factory=L.LearnConfig)
    columns: tuple[str, ...] = tuple(X.FEATURES)
    bar_minutes: int = 5
    half_lives: float = 3.0
    max_hold_minutes: float = 3 * 1440.0
    rules: ExitRules = ExitRules()
    costs: CostModel = CostModel()
    execution: Execution = Execution()
    meta: tuple[str, ...] = ()
    adf: bool = True

    @property
    def n_trials(self) -> int:
        return len(self.cfg.z_grid) * len(self.cfg.cost_grid)


def validation_pairs(bars: DataFrame, train_start: int, fit_end: int, bar_minutes: int = 60, **limits) -> DataFrame:
    """Pairs chosen on the fit part only: a pair picked for its validation days would validate itself."""
    from ..operators.panel import numbered_symbols

    closes = B.selection_closes(bars, train_start, fit_end, bar_minutes)
    return P.choose_pairs(P.pair_statistics(closes, P.all_pairs(numbered_symbols(closes)), bar_minutes, limits.pop("least", 200)), **limits)


def window_rows(bars: DataFrame, btc: DataFrame | None, pairs: DataFrame, start_ms: int, end_ms: int, plan: Plan) -> DataFrame:
    """Features and targets of the pairs from start_ms on; earlier bars only warm the windows up."""
    warm = (2 * 1440 + 120) * MINUTE_MS
    cut = lambda f: B.resample(B.time_slice(f, start_ms - warm, end_ms), plan.bar_minutes)
    rows = B.align(cut(bars), pairs, carry=("alpha", "beta", "half_life_minutes"))
    if btc is not None:
        rows = B.forward_fill_onto(rows, cut(btc), ["pair"], "ts_ms", "close", "btc_close")
    rows = X.pair_features(rows, plan.bar_minutes, btc=btc is not None, adf=plan.adf)
    hold = F.least(F.col("half_life_minutes") * plan.half_lives, F.lit(plan.max_hold_minutes)) / plan.bar_minutes
    rows = rows.withColumns({"z": F.col("z_24h"), "max_hold_bars": F.greatest(F.lit(1), F.floor(hold)).cast("int"), "half_life_hours": F.col("half_life_minutes") / 60})
    return L.dataset(rows, plan.cfg).withColumn("inside", F.col("ts_ms") >= start_ms)


def candidates(rows: DataFrame, cells: list[tuple[int, float, float]], start_ms: int, plan: Plan) -> DataFrame:
    """Trades of every cell (grid_idx, entry_z, cost_mult) from start_ms on: the cells are groups of one plan."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(z).alias("z"), F.lit(c).alias("c")) for k, z, c in cells]))
    own = rows.withColumn("_cell", each).withColumn("pair", marked(F.col("_cell.k"), "pair"))
    own = own.withColumn("signal", L.entry_with_edge("z", F.col("_cell.z"), F.col("_cell.c") * plan.costs.round_trip_rate, plan.cfg.penalty))
    own = own.withColumns({"edge": F.col("signal") * F.col("pred_ret") - plan.cfg.penalty * F.col("unc"), "abs_z": F.abs("z"), "in_window": F.col("ts_ms") >= start_ms})
    trades = simulate(own, plan.rules, execution=plan.execution, info=INFO)
    parts = F.split("pair", r"\|")
    return trades.withColumns({"grid_idx": parts[0].cast("int"), "pair": parts[1], "net_ret": F.col("gross_ret") - plan.costs.round_trip_rate, **{c: F.col("info")[c] for c in META}})


def learned_window(bars: DataFrame, btc: DataFrame | None, pairs: DataFrame, chosen_early: DataFrame, window: tuple, seed: int, plan: Plan, keep: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """Trades of the test days with grid_idx and what the model said; None if it can't be fitted or nothing worked in validation.

    pairs: of the whole training span, chosen_early: of its fit part (pair, asset1, asset2, alpha, beta, half_life_minutes). The
    model sees rows whose target ends before validation begins, thresholds are the first best cell there by net returns.
    keep: writes an intermediate table and reads it back.
    """
    _, train_start, train_end, test_start, test_end = window
    fit_end = train_start + int((1 - plan.cfg.val_fraction) * (train_end - train_start))
    rows = keep(window_rows(bars, btc, chosen_early, train_start, train_end, plan))
    models = L.fit_ensemble(L.fit_slice(rows.where("inside"), train_start, fit_end, plan.cfg.horizon * plan.bar_minutes * MINUTE_MS, plan.cfg), list(plan.columns), seed, plan.cfg)
    if models is None:
        return None
    cells = [(k, z, c) for k, (z, c) in enumerate((z, c) for z in plan.cfg.z_grid for c in plan.cfg.cost_grid)]
    tried = keep(candidates(L.predict(rows, models, list(plan.columns)), cells, fit_end, plan))
    scores = tried.groupBy("grid_idx").agg(F.count("*").alias("n"), F.sum("net_ret").alias("score"))
    grid = L.grid(bars.sparkSession, plan.cfg).select("grid_idx").join(scores, "grid_idx", "left").fillna(0)
    best = L.best_cell(grid).first()  # one row
    if best.sits:
        return None
    test = L.predict(window_rows(bars, btc, pairs, test_start, test_end, plan), models, list(plan.columns))
    trades = candidates(test, [cells[best.grid_idx]], test_start, plan)
    if plan.meta:
        model = L.fit_meta(tried.where(F.col("grid_idx") == best.grid_idx), list(plan.meta))
        trades = L.accept_meta(trades, model, list(plan.meta), plan.cfg.meta_least).where("meta_ok").drop("meta_ok")
    return trades


def cached(path: str, digest: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table under (path, digest of its inputs), made and written once: pair choices that several runs share."""
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession

    spark, own = SparkSession.active(), f"{path}/{digest}"
    try:
        return spark.read.parquet(own)
    except AnalysisException:
        made = f"{path}/.{digest}-{uuid.uuid4().hex}"
        make().write.parquet(made)
        at = spark._jvm.org.apache.hadoop.fs.Path
        at(made).getFileSystem(spark._jsc.hadoopConfiguration()).rename(at(made), at(own))  # all or nothing
        return spark.read.parquet(own)

