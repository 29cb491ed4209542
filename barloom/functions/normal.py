"""Normal distribution and what follows from it: Sharpe ratios against chance."""

from __future__ import annotations

import math
from statistics import NormalDist

EULER_GAMMA = 0.5772156649015329
_NORMAL = NormalDist()


def cdf(x: float) -> float:
    return _NORMAL.cdf(x)


def expected_max_sharpe(n_trials: int, variance: float) -> float:
    """Expected largest Sharpe ratio of n_trials strategies without skill."""
    if n_trials <= 1:
        return 0.0
    high = _NORMAL.inv_cdf(1 - 1 / n_trials)
    higher = _NORMAL.inv_cdf(1 - 1 / (n_trials * math.e))
    return math.sqrt(variance) * ((1 - EULER_GAMMA) * high + EULER_GAMMA * higher)


def probabilistic_sharpe(sharpe: float, n: int, skew: float, kurtosis: float, benchmark: float = 0.0) -> float:
    """Probability that the true ratio exceeds benchmark; kurtosis is 3 for a normal distribution."""
    spread = 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2
    if n < 3 or spread <= 0:
        return 0.0
    return cdf((sharpe - benchmark) * math.sqrt(n - 1) / math.sqrt(spread))


def deflated_sharpe(sharpe: float, n: int, skew: float, kurtosis: float, n_trials: int, variance: float | None = None) -> float:
    if n < 3:
        return 0.0
    return probabilistic_sharpe(sharpe, n, skew, kurtosis, expected_max_sharpe(n_trials, 1 / (n - 1) if variance is None else variance))
