"""The daily backtest and the strategies whose state runs through the days.

Each strategy (label) is one group: its days are sequential, strategies and simulations run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.costs import CostModel

LIQUIDATION = 20.0
RESULT = "label string, d_idx int, day_ms long, net double, gross double, cost double, funding double, turnover double, exposure double, interest double"


class Dense:
    """One group's long rows as days x symbols arrays, NaN where there is nothing."""

    def __init__(self, pdf: pd.DataFrame):
        days = pdf[["d_idx", "day_ms"]].drop_duplicates().sort_values("d_idx")
        names = pdf[["s_idx", "symbol"]].drop_duplicates().sort_values("s_idx")
        self.days, self.day_ms = days.d_idx.to_numpy(), days.day_ms.to_numpy()
        self.symbols, self.s_idx = names.symbol.tolist(), names.s_idx.to_numpy()
        self._at = np.searchsorted(self.days, pdf.d_idx.to_numpy()), np.searchsorted(self.s_idx, pdf.s_idx.to_numpy())
        self._pdf = pdf

    def grid(self, name: str, empty: float = np.nan) -> np.ndarray:
        out = np.full((len(self.days), len(self.symbols)), empty)
        if name in self._pdf:
            v = self._pdf[name].to_numpy(dtype=float, na_value=np.nan)
            out[self._at] = v if np.isnan(empty) else np.nan_to_num(v, nan=empty)
        return out

    def by_day(self, name: str, empty: float = 0.0) -> np.ndarray:
        if name not in self._pdf:
            return np.full(len(self.days), empty)
        v = self._pdf.groupby("d_idx")[name].max().reindex(self.days)
        return v.to_numpy(dtype=float, na_value=empty)


def walk(close: np.ndarray, funding: np.ndarray, weights: np.ndarray, rebalance: np.ndarray, rate: np.ndarray | float, cash: np.ndarray, tied: np.ndarray) -> np.ndarray:
    """Rows (net, gross, cost, funding, turnover, exposure, interest) for the days after the first.

    With R the day's returns (0 where either close is missing) and T what can be traded, the book after a close is
    A = T (rebalance ? W : H), and the next one H = A (1 + R) / (1 + A R). A day whose net or gross return is -100 %
    or worse, or that leaves |H| above LIQUIDATION, is -100 %; all days after it are 0.
    """
    n = max(0, len(close) - 1)
    out = np.zeros((n, 7))
    can = np.isfinite(close)
    returns = np.where(can[:-1] & can[1:], np.nan_to_num(close[1:]) / np.where(can[:-1], close[:-1], 1.0) - 1, 0.0)
    wanted, idle = np.nan_to_num(weights) * can, np.maximum(1 - tied, 0.0)
    book = np.zeros(close.shape[1])
    for d, r in enumerate(returns):
        target = wanted[d] if rebalance[d] else book * can[d]
        trades = np.abs(target - book)
        won, paid, cost, earned = target @ r, target @ funding[d + 1], (trades * rate).sum(), idle[d] * cash[d + 1]
        net = won - paid - cost + earned
        book = target * (1 + r) / (1 + won) if won > -1 else target * np.inf
        over = not (net > -1 and np.abs(book).sum() <= LIQUIDATION)
        out[d] = -1.0 if over else net, won, cost, paid, trades.sum(), np.abs(target).sum(), earned
        if over:
            break
    return out


def run_daily(panel: DataFrame, weights: DataFrame, rebalance: DataFrame | None = None, costs: CostModel = CostModel(), rates: DataFrame | None = None, cash: DataFrame | None = None, tied: DataFrame | None = None) -> DataFrame:
    """Daily results of each label of weights (label, d_idx, symbol, w) over the panel.

    rebalance: (label, d_idx), all days if None. rates: (symbol, rate) of dearer columns before the
    multiplier. cash: (d_idx, cash_rate) earned on 1 - tied; tied: (label, d_idx, tied).
    """
    labels = weights.select("label").distinct() if rebalance is None else weights.select("label").union(rebalance.select("label")).distinct()
    rows = panel.join(F.broadcast(labels)).join(weights.select("label", "d_idx", "symbol", "w"), ["label", "d_idx", "symbol"], "left")
    if rebalance is not None:
        rows = rows.join(rebalance.select("label", "d_idx", F.lit(1.0).alias("reb")), ["label", "d_idx"], "left")
    if rates is not None:
        rows = rows.join(F.broadcast(rates), "symbol", "left")
    if cash is not None:
        rows = rows.join(F.broadcast(cash.select("d_idx", "cash_rate")), "d_idx", "left")
    if tied is not None:
        rows = rows.join(tied, ["label", "d_idx"], "left")
    every, base, times = rebalance is None, costs.default_rate, costs.multiplier

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = Dense(pdf)
        rate = base
        if "rate" in pdf:
            each = pdf.groupby("s_idx")["rate"].max().reindex(own.s_idx).to_numpy(dtype=float, na_value=np.nan)
            rate = np.where(np.isnan(each), base, each * times)
        reb = np.ones(len(own.days), bool) if every else own.by_day("reb") > 0
        out = walk(own.grid("close"), own.grid("funding", 0.0), own.grid("w", 0.0), reb, rate, own.by_day("cash_rate"), own.by_day("tied"))
        names = ["net", "gross", "cost", "funding", "turnover", "exposure", "interest"]
        return pd.DataFrame({"label": key[0], "d_idx": own.days[1:], "day_ms": own.day_ms[1:]} | {n: out[:, k] for k, n in enumerate(names)})

    return rows.groupBy("label").applyInPandas(run, RESULT)


HARVEST = "label string, kind string, d_idx int, symbol string, w double, until int"


def harvest(candidates: DataFrame, n_days: int, enter: float = 0.0035, leave: float = 0.0015, slots: int = 10, notional: float = 1 / 15) -> DataFrame:
    """Short perpetual and long spot while trailing funding is high, with hysteresis over at most `slots` coins.

    candidates: (label, d_idx, symbol, s_idx, f7) of the coins that may be held on a day. Rows of kind
    weight (perpetual -notional, SPOT: +notional), rebalance (a day that changes positions) and episode
    (entry day in d_idx, exit day in until).
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, int] = {}
        out: list[tuple] = []
        by_day = {d: g.sort_values("s_idx") for d, g in pdf.groupby("d_idx")}
        first = min(by_day, default=n_days)
        for d in range(first, n_days):
            today = by_day.get(d)
            f7 = {} if today is None else dict(zip(today.symbol, today.f7))
            gone = [s for s in held if not f7.get(s, -np.inf) >= leave]
            out += [(key[0], "episode", held.pop(s), s, 0.0, d) for s in gone]
            fresh = [] if today is None else sorted((-f, i, s) for s, i, f in zip(today.symbol, today.s_idx, today.f7) if f >= enter and s not in held)
            fresh = fresh[: max(0, slots - len(held))]
            held |= {s: d for _, _, s in fresh}
            for s in held:
                out += [(key[0], "weight", d, s, -notional, None), (key[0], "weight", d, "SPOT:" + s, notional, None)]
            if gone or fresh:
                out.append((key[0], "rebalance", d, "", 0.0, None))
        out += [(key[0], "episode", d, s, 0.0, n_days) for s, d in held.items()]
        return pd.DataFrame(out, columns=["label", "kind", "d_idx", "symbol", "w", "until"]).astype({"until": "Int64"})

    return candidates.groupBy("label").applyInPandas(run, HARVEST)


def harvest_candidates(panel: DataFrame, label: str = "harvest", top_n: int = 60, lookback: int = 7, min_history: int = 30) -> DataFrame:
    """Liquid perpetuals whose spot also has a close on each of the last min_history days, with their trailing funding."""
    from .panel import SPOT, liquid_universe, live, trailing_funding

    perps = panel.where(~F.col("symbol").startswith(SPOT)).withColumn("f7", trailing_funding(lookback))
    spot = panel.where(F.col("symbol").startswith(SPOT)).withColumn("_live", live(min_history)).where("_live")
    spot = spot.select("d_idx", F.expr(f"substring(symbol, {len(SPOT) + 1})").alias("symbol"))
    rows = liquid_universe(perps, top_n, min_history).where(F.col("d_idx") >= max(min_history, lookback))
    return rows.join(spot, ["d_idx", "symbol"], "left_semi").select(F.lit(label).alias("label"), "d_idx", "symbol", "s_idx", "f7")


def random_episodes(episodes: DataFrame, candidates: DataFrame, n_sims: int, seed: int = 0) -> DataFrame:
    """(sim, d_idx, until, symbol): every episode keeps its days but holds a random candidate of its entry day that is not busy."""
    pool = candidates.groupBy("d_idx").agg(F.sort_array(F.collect_set("symbol")).alias("pool"))  # a universe at most
    own = episodes.join(pool, "d_idx", "left").select("d_idx", "until", "symbol", "pool")
    sims = own.sparkSession.range(n_sims).withColumnRenamed("id", "sim")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r, busy, out = np.random.default_rng([seed, int(key[0])]), {}, []
        for e in pdf.sort_values(["d_idx", "symbol"]).itertuples():
            free = [s for s in (e.pool if e.pool is not None else []) if busy.get(s, -1) <= e.d_idx]
            if free:
                s = str(r.choice(free))
                busy[s] = e.until
                out.append((key[0], e.d_idx, e.until, s))
        return pd.DataFrame(out, columns=["sim", "d_idx", "until", "symbol"])

    return sims.join(F.broadcast(own)).groupBy("sim").applyInPandas(run, "sim long, d_idx int, until int, symbol string")


SIZED = "label string, d_idx int, symbol string, w double, reb boolean, tied double"


def sized_harvest(held: DataFrame, cap: float = 0.25, rehedge_up: float = 0.5) -> DataFrame:
    """Each day's held perpetuals sized q = min(cap, 1 / 2n) a leg; re-hedged where one is rehedge_up above its last hedge.

    held: (label, d_idx, symbol, s_idx, close, changed) of all days, symbol NULL on days without positions.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        ref: dict[str, float] = {}
        for d, g in pdf.sort_values(["d_idx", "s_idx"]).groupby("d_idx"):
            changed = bool(g.changed.max())
            own = g[g.symbol.notna()]
            if own.empty:
                ref = {}
                out.append((key[0], d, None, 0.0, changed, 0.0))
                continue
            now = dict(zip(own.symbol, own.close.astype(float)))
            q = min(cap, 1 / (2 * len(now)))
            up = any(s in ref and np.isfinite(c) and c >= (1 + rehedge_up) * ref[s] for s, c in now.items())
            reb = changed or up
            if reb or set(ref) != set(now):
                ref = now
            for s in now:
                out += [(key[0], d, s, -q, reb, 2 * q * len(now)), (key[0], d, "SPOT:" + s, q, reb, 2 * q * len(now))]
        return pd.DataFrame(out, columns=["label", "d_idx", "symbol", "w", "reb", "tied"])

    return held.groupBy("label").applyInPandas(run, SIZED)


def margin_breaches(panel: DataFrame, weights: DataFrame, rebalance: DataFrame, margin: float, maintenance: float = 0.05) -> DataFrame:
    """(label, d_idx): days on which the short perpetuals would fall below maintenance if all traded at their highs at once.

    weights: (label, d_idx, symbol, w) of shorts; rebalance: (label, d_idx).
    """
    rows = panel.select("d_idx", "day_ms", "symbol", "s_idx", "close", "high").join(F.broadcast(weights.select("label").distinct()))
    rows = rows.join(weights.where("w < 0").select("label", "d_idx", "symbol", "w"), ["label", "d_idx", "symbol"], "left")
    rows = rows.join(rebalance.select("label", "d_idx", F.lit(1.0).alias("reb")), ["label", "d_idx"], "left")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = Dense(pdf)
        close, high, w, reb = own.grid("close"), own.grid("high"), own.grid("w", 0.0), own.by_day("reb") > 0
        ref = size = before = None
        out = []
        for d in range(len(own.days) - 1):
            held = w[d] < 0
            if not held.any():
                ref = None
                continue
            if ref is None or reb[d] or (held != before).any():
                ref, size, before = close[d, held], -w[d, held], held
            top = np.where(np.isfinite(high[d + 1, held]), high[d + 1, held], np.where(np.isfinite(close[d + 1, held]), close[d + 1, held], ref))
            rise = top / ref
            if (size * (margin - (rise - 1))).sum() < maintenance * (size * rise).sum():
                out.append((key[0], own.days[d + 1]))
        return pd.DataFrame(out, columns=["label", "d_idx"])

    return rows.groupBy("label").applyInPandas(run, "label string, d_idx int")


def listing_shorts(panel: DataFrame, listings: DataFrame, hedge: str, hold_days: int = 30, size: float = 0.1, most: int = 10, label: str = "listing") -> tuple[DataFrame, DataFrame]:
    """(weights, events): short each newly listed coin from the day after its listing, hedged, at most `most` at a time.

    listings: (symbol, d_idx) of first trading days. An event ends where the coin has no close. The events
    are few and admitted in one pass over them; weights expand from them in Spark.
    """
    days = panel.agg((F.max("d_idx") + 1).alias("_n"))
    closes = panel.where("close IS NOT NULL").select("symbol", "d_idx")
    entry = listings.select("symbol", (F.col("d_idx") + 1).alias("entry")).join(F.broadcast(days)).where(F.col("entry") < F.col("_n") - 1)
    span = entry.withColumn("end", F.least(F.col("entry") + hold_days, F.col("_n")))
    seen = span.join(closes, "symbol").where("d_idx >= entry AND d_idx < end").groupBy("symbol", "entry", "end").agg(F.collect_set("d_idx").alias("_seen"))
    missing = F.array_min(F.array_except(F.sequence("entry", F.col("end") - 1), F.col("_seen")))
    own = seen.withColumn("until", F.coalesce(missing, F.col("end"))).where("until > entry").select("symbol", "entry", "until")

    def admit(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, ends = [], []
        for e in pdf.sort_values(["entry", "symbol"]).itertuples():
            ends = [x for x in ends if x > e.entry]
            if len(ends) < most:
                ends.append(e.until)
                out.append((e.symbol, e.entry, e.until))
        return pd.DataFrame(out, columns=["symbol", "entry", "until"])

    events = own.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(admit, "symbol string, entry int, until int")
    each = events.select("symbol", F.explode(F.sequence("entry", F.col("until") - 1)).alias("d_idx"))
    legs = each.select("d_idx", "symbol", F.lit(-size).alias("w")).union(each.select("d_idx", F.lit(hedge).alias("symbol"), F.lit(size).alias("w")))
    return legs.groupBy("d_idx", "symbol").agg(F.sum("w").alias("w")).withColumn("label", F.lit(label)), events
