"""Candle streams with state by symbol: closed candles from updates, and N-minute bars from closed minutes.

Arrow may hand a key's rows of one micro-batch over in pieces. Every processor gathers and sorts them before
its state sees any, so results don't depend on the size of the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import MINUTE_MS, bucket

CANDLE = "symbol string, ts_ms long, open double, high double, low double, close double, volume double, taker_buy_volume double"
BAR = CANDLE + ", n_minutes int"
_CELLS = ["ts_ms", "open", "high", "low", "close", "volume", "taker_buy_volume"]


def gathered(pieces: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """All rows of a key's micro-batch, in order; ties stay as they came."""
    rows = pd.concat(list(pieces), ignore_index=True)
    return rows.sort_values([c for c in order if c in rows], kind="stable", ignore_index=True)


def final_candles(updates: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(final candles, the open one) of updates in order of arrival.

    An update older than one seen before is stale; of each time the last update holds; a candle is final as
    soon as a later one has begun.
    """
    fresh = updates[updates.ts_ms == updates.ts_ms.cummax()].drop_duplicates("ts_ms", keep="last")
    return fresh.iloc[:-1], fresh.iloc[-1:]


def complete_bars(minutes: pd.DataFrame, bar_ms: int, told: int) -> tuple[pd.DataFrame, pd.DataFrame, int]:
    """(bars, minutes that still wait, start of the last bar told).

    A bar is complete with the last minute of its time, whatever else is missing; minutes of bars told before
    and of older bars that never became complete are dropped. A bar has a taker volume if all its minutes do.
    """
    own = minutes.drop_duplicates("ts_ms", keep="last").sort_values("ts_ms")
    own = own.assign(slot=own.ts_ms - own.ts_ms % bar_ms)
    own = own[own.slot > told]
    ends = own.slot[own.ts_ms == own.slot + bar_ms - MINUTE_MS]
    if ends.empty:
        return own.iloc[:0].drop(columns="slot").assign(n_minutes=0), own.drop(columns="slot"), told
    by = own[own.slot.isin(ends)].groupby("slot")
    bars = by.agg(open=("open", "first"), high=("high", "max"), low=("low", "min"), close=("close", "last"), volume=("volume", "sum"), n_minutes=("ts_ms", "size"))
    bars.insert(5, "taker_buy_volume", by.taker_buy_volume.sum().where(by.taker_buy_volume.count() == bars.n_minutes))
    last = int(ends.max())
    return bars.rename_axis("ts_ms").reset_index(), own[own.slot > last].drop(columns="slot"), last


def _cells(rows: pd.DataFrame) -> list[tuple]:
    """Rows as state values: NaN is None there."""
    return [tuple(None if pd.isna(x) else int(x) if k == 0 else float(x) for k, x in enumerate(t)) for t in rows[_CELLS].itertuples(index=False, name=None)]


_ROW = "ts_ms long, open double, high double, low double, close double, volume double, taker_buy_volume double"


class ClosedCandles(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", _ROW)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = gathered(rows, ["seq"])[_CELLS]
        if self.current.exists():
            new = pd.concat([pd.DataFrame([tuple(self.current.get())], columns=_CELLS).astype(new.dtypes.to_dict()), new], ignore_index=True)
        final, still_open = final_candles(new)
        self.current.update(_cells(still_open)[0])
        yield final.assign(symbol=key[0])[["symbol", *_CELLS]]

    def close(self) -> None:
        pass


class MinuteBars(StatefulProcessor):
    def __init__(self, bar_minutes: int):
        self.bar_ms = bar_minutes * MINUTE_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.minutes = handle.getMapState("minutes", "ts long", _ROW)
        self.told = handle.getValueState("told", "ts long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A row of open_minutes(): the minutes of the bar that was open, and the last bar before it."""
        for r in initialState.itertuples():
            for t in _cells(pd.DataFrame({c: getattr(r, c) for c in _CELLS})):
                self.minutes.updateValue((t[0],), t)
            self.told.update((int(r.told),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = gathered(rows, ["ts_ms"])[_CELLS].astype({c: float for c in _CELLS[1:]})
        before = {k[0]: tuple(v) for k, v in self.minutes.iterator()}
        held = pd.DataFrame(list(before.values()), columns=_CELLS).astype(new.dtypes.to_dict())
        told = int(self.told.get()[0]) if self.told.exists() else -1
        bars, rest, told = complete_bars(pd.concat([held, new], ignore_index=True) if len(held) else new, self.bar_ms, told)
        after = {t[0]: t for t in _cells(rest)}
        for t in before.keys() - after.keys():
            self.minutes.removeKey((t,))
        for t, r in after.items():
            if before.get(t) != r:
                self.minutes.updateValue((t,), r)
        self.told.update((told,))
        yield bars.assign(symbol=key[0])[["symbol", *_CELLS, "n_minutes"]].astype({"n_minutes": np.int32})

    def close(self) -> None:
        pass


def open_minutes(history: DataFrame, bar_minutes: int) -> DataFrame:
    """(symbol, told, an array for each cell): what a history of closed minutes leaves open, as an initial state.

    Bars whose last minute the history holds are done; the minutes after them wait for the live ones.
    """
    bar_ms = bar_minutes * MINUTE_MS
    last = history.groupBy("symbol").agg(F.max("ts_ms").alias("_last"))
    slot = bucket(F.col("_last") + MINUTE_MS, bar_ms)
    own = history.join(last.select("symbol", slot.alias("_open")), "symbol")
    cells = F.array_sort(F.collect_list(F.when(F.col("ts_ms") >= F.col("_open"), F.struct(*_CELLS))))  # a bar's minutes at most
    waits = own.groupBy("symbol").agg(cells.alias("m"), (F.max("_open") - bar_ms).alias("told"))
    return waits.select("symbol", "told", *[F.col(f"m.{c}").alias(c) for c in _CELLS])


def _stateful(rows: DataFrame, processor: StatefulProcessor, schema: str, key: str = "symbol", initial: DataFrame | None = None) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = None if initial is None else initial.groupBy(key)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None", initialState=start)


def closed_candles(updates: DataFrame) -> DataFrame:
    """A stream of updates (symbol, candle, seq in order of arrival) as a stream of final candles."""
    return _stateful(updates, ClosedCandles(), CANDLE)


def minute_bars(candles: DataFrame, bar_minutes: int, initial: DataFrame | None = None) -> DataFrame:
    """A stream of closed minutes as a stream of bars; initial: open_minutes() of the history before it."""
    return _stateful(candles, MinuteBars(bar_minutes), BAR, initial=initial)


def windowed_bars(candles: DataFrame, bar_minutes: int, late: str = "10 minutes") -> DataFrame:
    """The plain variant by event time: a bar is final when the watermark has passed it, complete or not."""
    at = candles.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    out = at.groupBy(F.window("at", f"{bar_minutes} minutes"), "symbol").agg(
        F.min_by("open", "ts_ms").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts_ms").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n_minutes")
    )
    return out.select("symbol", F.unix_millis("window.start").alias("ts_ms"), "open", "high", "low", "close", "volume", "n_minutes")


def join_legs(left: DataFrame, right: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Bars of both legs of a pair by time: a stream-stream join whose state the watermark bounds."""
    mark = lambda f, n: f.select("pair", F.timestamp_millis("ts_ms").alias("at"), "ts_ms", *[F.col(c).alias(f"{c}{n}") for c in ("open", "high", "low", "close", "volume")]).withWatermark("at", late)
    return mark(left, 1).join(mark(right, 2).drop("ts_ms"), ["pair", "at"]).drop("at")
