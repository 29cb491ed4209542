"""Go criteria as boolean columns and as a line of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(summary: DataFrame, criteria: dict[str, Column]) -> DataFrame:
    """summary with a boolean for each criterion, go (all hold; a missing value doesn't) and a report line."""
    marks = {f"go_{n}": F.coalesce(c, F.lit(False)) for n, c in criteria.items()}
    out = summary.withColumns(marks)
    every = F.lit(True)
    for n in marks:
        every = every & F.col(n)
    line = F.concat_ws(" ", *[F.concat(F.when(F.col(f"go_{n}"), "✓ ").otherwise("✗ "), F.lit(n)) for n in criteria])
    return out.withColumns({"go": every, "report": line})


def trade_criteria() -> dict[str, Column]:
    """The protocol's criteria over run_summary() with the p_value of the random-entry benchmark."""
    return {
        "trades": F.col("n_trades") >= 200, "interval": F.col("ci_lower_bp") > 0, "sharpe": F.col("sharpe") >= 1,
        "dsr": F.col("dsr") >= 0.95, "benchmark": F.col("p_value") < 0.05,
    }


def _cells(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("nan")) for c in cells]), F.lit(" |"))


def trade_row(run: Column, label: Column) -> Column:
    """A run's markdown row: trades, money, mean returns with their interval, ratios, benchmark, and the marks of judged()."""
    return _cells(
        run, label, F.col("n_trades").cast("string"), F.format_string("%.2f", "net_pnl"), F.format_string("%.1f", "mean_gross_ret_bp"),
        F.format_string("%.1f [%.1f, %.1f]", "mean_net_ret_bp", "ci_lower_bp", "ci_upper_bp"), F.format_string("%.2f", "sharpe"),
        F.format_string("%.1f%%", F.col("max_drawdown") * 100), F.format_string("%.3f", "dsr"), F.format_string("%.3f", "p_value"), F.col("report"),
    )


def daily_row(run: Column) -> Column:
    """A daily strategy's markdown row; it has no criteria, but its benchmarks' ratios."""
    return _cells(
        run, F.col("n_days").cast("string"), F.format_string("%.1f%%", F.col("total_return") * 100), F.format_string("%.1f%%", F.col("cagr") * 100), F.format_string("%.2f", "sharpe"),
        F.format_string("%.1f%%", F.col("max_drawdown") * 100), F.format_string("%.2f [%.2f, %.2f]", "mean_daily_bp", "ci_lower_bp", "ci_upper_bp"),
        F.format_string("%.3f", "dsr"), F.format_string("%.3f", "p_value"), F.format_string("%.2f", "btc_long_sharpe"), F.format_string("%.2f", "equal_weight_sharpe"),
    )
