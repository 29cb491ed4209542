"""Unit-root tests in numpy: augmented Dickey-Fuller and Engle-Granger with MacKinnon's (1994) p-values."""

from __future__ import annotations

import numpy as np

from .normal import cdf

#: Fixed values (MacKinnon 1994, constant only): tau range, switch point, polynomials below and above it.
_SURFACE = {
    1: (-18.83, 2.74, -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    2: (-18.86, 0.92, -2.62, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
}


def p_value(tau: float, n_series: int = 1) -> float:
    low, high, switch, small, large = _SURFACE[n_series]
    if tau > high:
        return 1.0
    if tau < low:
        return 0.0
    return cdf(sum(c * tau**k for k, c in enumerate(small if tau <= switch else large)))


def _regress(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ b
    return b, float(rest @ rest), rest


def _lagged(x: np.ndarray, lags: int, constant: bool, skip: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(x)
    y = d[skip:]
    cols = [x[skip:-1], *[d[skip - k : len(d) - k] for k in range(1, lags + 1)]]
    return y, np.column_stack(cols + [np.ones(len(y))] * constant)


def adf_tau(x: np.ndarray, lags: int, constant: bool = True) -> float:
    """The t statistic of the level in the Dickey-Fuller regression with so many lagged differences."""
    y, design = _lagged(np.asarray(x, float), lags, constant, lags)
    b, ssr, _ = _regress(y, design)
    cov = np.linalg.pinv(design.T @ design) * ssr / (len(y) - design.shape[1])
    return float(b[0] / np.sqrt(cov[0, 0]))


def adf_p(x: np.ndarray, lags: int = 1) -> float | None:
    """p-value with a fixed number of lags and a constant; None where it is not defined."""
    x = np.asarray(x, float)
    if len(x) < 2 * lags + 4 or not np.isfinite(x).all() or np.std(x) == 0:
        return None
    tau = adf_tau(x, lags)
    return p_value(tau) if np.isfinite(tau) else None


def _best_lag(x: np.ndarray, most: int) -> int:
    """Lag with the lowest AIC, all fitted over the same rows."""
    best, at = np.inf, 0
    for lags in range(most + 1):
        y, design = _lagged(x, lags, False, most)
        _, ssr, _ = _regress(y, design)
        n = len(y)
        aic = n * (np.log(2 * np.pi * ssr / n) + 1) + 2 * design.shape[1]
        if aic < best:
            best, at = aic, lags
    return at


def engle_granger_p(y: np.ndarray, x: np.ndarray) -> float | None:
    """Cointegration p-value: residuals of y on a constant and x, AIC lags, no constant in the second step."""
    y, x = np.asarray(y, float), np.asarray(x, float)
    n = len(y)
    _, ssr, rest = _regress(y, np.column_stack([np.ones(n), x]))
    if ssr < 1e-12 * max(1.0, float(y @ y)):
        return 0.0
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    if most < 0:
        return None
    tau = adf_tau(rest, _best_lag(rest, most), constant=False)
    return p_value(tau, 2) if np.isfinite(tau) else None
