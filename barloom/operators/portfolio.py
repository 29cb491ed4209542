"""The event-driven portfolio: candidates in order of entry, realized equity, limits and costs."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DAY_MS
from ..functions.costs import CostModel
from .asof import interval_sum


@dataclass(frozen=True)
class PortfolioConfig:
    start_equity: float = 1000.0
    alloc_per_trade: float = 0.25
    max_positions: int = 4
    max_gross_leverage: float = 1.0


def with_funding(trades: DataFrame, pairs: DataFrame, funding: DataFrame, slice_ms: int = 90 * DAY_MS) -> DataFrame:
    """trades with rates1 and rates2: the sums of their legs' rates while they are open, a symbol's history cut into slices."""
    out = trades.join(pairs.select("pair", "asset1", "asset2"), "pair")
    for n in (1, 2):
        own = out.withColumn("symbol", F.col(f"asset{n}"))
        out = interval_sum(own, funding, ["symbol"], "entry_ts", "exit_ts", "ts_ms", "funding_rate", f"rates{n}", slice_ms).drop("symbol")
    return out


_BOOK = "accepted boolean, gross_notional double, gross_pnl double, execution_cost double, funding_cost double, net_pnl double, net_ret double, equity_at_entry double, equity_after double, seq int"


def run_portfolio(trades: DataFrame, costs: CostModel = CostModel(), cfg: PortfolioConfig = PortfolioConfig(), keys: tuple[str, ...] = ("label",), accept: Column | None = None) -> DataFrame:
    """Every candidate of each group with what became of it; rejected ones have accepted false and no money.

    Positions that ended by a candidate's entry are realized first, by (exit_ts, pair). A candidate is
    rejected if accept is not true, its pair is open, all places are taken or no notional is left. seq is
    the order in which equity was realized.
    """
    rows = trades.withColumn("is_fine", F.lit(True) if accept is None else F.coalesce(accept, F.lit(False)))
    names = [f.name for f in trades.schema.fields]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trades.schema.fields)
    booked = [x.split()[0] for x in _BOOK.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        equity, gross, done = cfg.start_equity, 0.0, 0
        open_now: list[tuple[int, str, int]] = []
        cells: list[list] = [[False, *[None] * 9] for _ in range(len(pdf))]
        flag = lambda t, n: None if not hasattr(t, n) or pd.isna(getattr(t, n)) else bool(getattr(t, n))

        def realize(until: float) -> None:
            nonlocal equity, gross, done
            while open_now and open_now[0][0] <= until:
                own = cells[heapq.heappop(open_now)[2]]
                equity += own[5]
                gross -= own[1]
                own[8], own[9] = equity, done
                done += 1

        pdf = pdf.sort_values(["entry_ts", "pair"]).reset_index(drop=True)
        for k, t in enumerate(pdf.itertuples()):
            realize(t.entry_ts)
            if not open_now:
                gross = 0.0
            size = min(cfg.alloc_per_trade * equity, cfg.max_gross_leverage * equity - gross)
            if not t.is_fine or any(p == t.pair for _, p, _ in open_now) or len(open_now) >= cfg.max_positions or size <= 1e-9 or equity <= 0:
                continue
            n1, n2 = size * t.w1, size * t.w2
            paid = sum(
                costs.fill_cost_value(n, v, flag(t, m))
                for n, v, m in (
                    (n1, t.entry_vol1_usd, "entry_maker1"), (n2, t.entry_vol2_usd, "entry_maker2"),
                    (n1 * t.exit_p1 / t.entry_p1, t.exit_vol1_usd, "exit_maker1"), (n2 * t.exit_p2 / t.entry_p2, t.exit_vol2_usd, "exit_maker2"),
                )
            )
            carried = t.side * (n1 * getattr(t, "rates1", 0.0) - n2 * getattr(t, "rates2", 0.0))
            won = size * t.gross_ret
            net = won - paid - carried
            cells[k][:] = [True, size, won, paid, carried, net, net / size, equity, None, None]
            heapq.heappush(open_now, (t.exit_ts, t.pair, k))
            gross += size
        realize(float("inf"))
        book = pd.DataFrame(cells, columns=booked).astype({"accepted": bool, "seq": "Int64"})
        return pd.concat([pdf[names], book], axis=1)

    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, {_BOOK}")

