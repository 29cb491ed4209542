"""Small Column builders: NULL is the only missing value inside the engine."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MINUTE_MS = 60_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: str | Column) -> Column:
    """NaN and infinities become NULL."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def log(x: str | Column) -> Column:
    """Natural logarithm, NULL where there is none."""
    return F.when(col(x) > 0, F.ln(col(x)))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL for a zero denominator."""
    return F.try_divide(col(a), col(b))


def bucket(ts: str | Column, step_ms: int) -> Column:
    """Start of the step that holds ts; also right before 1970."""
    return col(ts) - F.pmod(col(ts), F.lit(step_ms))


def day_of(ts: str | Column) -> Column:
    return bucket(ts, DAY_MS)


def weekday(day_ms: str | Column) -> Column:
    """Weekday of the close of a day (00:00 of the next), Monday is 0."""
    return F.pmod(F.floor(col(day_ms) / DAY_MS) + 4, F.lit(7)).cast("int")


def bars_in(minutes: float, bar_minutes: int) -> int:
    """Rows that a span of minutes covers, at least one."""
    return max(1, round(minutes / bar_minutes))


def clip(x: str | Column, low: float | Column, high: float | Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_col(low), F.least(as_col(high), col(x)))


def last_rows(keys: list[str], order: str, n: int) -> WindowSpec:
    """The current row and the n - 1 before it. Windows count rows, never time."""
    return W.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)


def so_far(keys: list[str], order: str) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)


def symbol_stem(symbol: str | Column) -> Column:
    """DOT/USDT, DOTUSDT, DOT_USDT and DOT/USDT:USDT are all DOT_USDT."""
    bare = F.regexp_replace(F.regexp_replace(col(symbol), ":USDT$", ""), "[/_]", "")
    return F.when(bare.endswith("USDT") & (F.char_length(bare) > 4), F.regexp_replace(bare, "USDT$", "_USDT")).otherwise(bare)


def product_of_growth(returns: str | Column) -> Column:
    """Aggregate: product of 1 + r, and 0 as soon as one return is -100 % or worse."""
    grown = 1 + col(returns)
    return F.when(F.min(grown) <= 0, F.lit(0.0)).otherwise(F.exp(F.sum(F.when(grown > 0, F.ln(grown)))))
