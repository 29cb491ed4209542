"""Live decisions of the learned strategy: micro-batches run the batch engine's features over a bounded history."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.bars import keep_last
from ..operators.features import crossing, pair_features
from .engine import _ACTIONS, DECISION, LiveConfig, Position, decide

_POSITION = "pair string, last_ts long, side int, entry_z double, held int, open1 double, open2 double"


@dataclass(frozen=True)
class ModelStream:
    """foreachBatch target: bars (pair, ts_ms, open1 .. taker_buy_volume2, alpha, beta, btc_close) in, decisions out.

    score adds pred_ret and unc to rows of features. Each batch writes a folder of its own with decisions, positions
    and the history that the next one needs, and reads the folder before it: a batch that is repeated replaces its
    folder and decides the same. A pair's newest bar waits while BTC's bar of that time is missing and none later is
    there; BTC's close is carried forward as in the backtest, and unit-root values hold for their clock hour.
    """

    folder: str
    cfg: LiveConfig
    score: Callable[[DataFrame], DataFrame]
    bar_minutes: int
    need: float = 0.0
    penalty: float = 1.0
    adf: bool = True
    history: int = 2000

    def _before(self, spark, batch_id: int, part: str, schema=None) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.folder}/batch={batch_id - 1}/{part}")
        except AnalysisException:
            return None if schema is None else spark.createDataFrame([], schema)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, at = batch.sparkSession, f"{self.folder}/batch={batch_id}"
        old = self._before(spark, batch_id, "history")
        positions = self._before(spark, batch_id, "positions", _POSITION)
        new = batch.withColumn("_new", F.lit(1))
        rows = new if old is None else new.unionByName(old.withColumn("_new", F.lit(0)))
        rows = keep_last(rows, ["pair", "ts_ms"], "_new").drop("_new")
        latest = W.partitionBy("pair").orderBy(F.desc("ts_ms"))
        rows = rows.withColumn("_age", F.row_number().over(latest)).where(F.col("_age") <= self.history)
        until = F.coalesce(F.max(F.when(F.col("btc_close").isNotNull(), F.col("ts_ms"))).over(W.partitionBy("pair")), F.lit(-1))
        waits = F.col("btc_close").isNull() & (F.col("_age") == 1) & (until < F.col("ts_ms"))
        rows = rows.withColumn("_waits", waits)
        rows.drop("_age", "_waits").write.mode("overwrite").parquet(f"{at}/history")
        along = W.partitionBy("pair").orderBy("ts_ms").rowsBetween(W.unboundedPreceding, 0)
        ready = rows.where("NOT _waits").withColumn("btc_close", F.last("btc_close", ignorenulls=True).over(along)).drop("_age", "_waits")
        scored = self.score(pair_features(ready, self.bar_minutes, btc=True, adf=self.adf))
        cross = crossing("z_24h", ["pair"], "ts_ms", self.cfg.entry_z)
        edge = cross * F.col("pred_ret") - self.penalty * F.col("unc")
        signal = F.when((cross != 0) & (edge > self.need), cross).otherwise(0)
        if self.cfg.entries_until is not None:
            signal = F.when(F.col("ts_ms") < self.cfg.entries_until, signal).otherwise(0)
        own = scored.withColumn("signal", signal).select("pair", "ts_ms", "open1", "open2", "close1", "close2", "beta", F.col("z_24h").alias("z"), "signal")
        rules = self.cfg.rules

        def run(key: tuple, bars: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            bars, position, last_ts = bars.sort_values("ts_ms"), Position(), -1
            for h in held.itertuples():
                opens = (None, None) if pd.isna(h.open1) else (float(h.open1), float(h.open2))
                position, last_ts = Position(int(h.side), float(h.entry_z), int(h.held), *opens), int(h.last_ts)
            bars, out = bars[bars.ts_ms > last_ts], []
            if len(bars):
                z = bars.z.to_numpy(dtype=float, na_value=np.nan)
                out, position = decide(bars, z, bars.signal.to_numpy(), position, float(bars.beta.iloc[0]), rules)
                last_ts = int(bars.ts_ms.iloc[-1])
            made = pd.DataFrame([(key[0], *x) for x in out], columns=["pair", *_ACTIONS])
            state = pd.DataFrame([(key[0], last_ts, "state", position.side, position.entry_z, None, position.held)], columns=["pair", *_ACTIONS])
            both = pd.concat([f for f in (made, state) if len(f)], ignore_index=True)
            return both.assign(open1=position.open1, open2=position.open2).astype({"open1": "Float64", "open2": "Float64"})

        told = own.groupBy("pair").cogroup(positions.groupBy("pair")).applyInPandas(run, f"{DECISION}, open1 double, open2 double")
        told.write.mode("overwrite").parquet(f"{at}/told")
        told = spark.read.parquet(f"{at}/told")
        told.where("action <> 'state'").drop("open1", "open2").write.mode("overwrite").parquet(f"{at}/decisions")
        state = told.where("action = 'state'").select("pair", F.col("ts_ms").alias("last_ts"), "side", F.col("z").alias("entry_z"), "held", "open1", "open2")
        state.write.mode("overwrite").parquet(f"{at}/positions")

    def decisions(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/batch=*/decisions")
