"""The distribution tails of ``tails`` evaluated on the driver, for single numbers."""

from __future__ import annotations

import math

from .tails import NUMBERS, _beta_lower, _gamma_upper, _kolmogorov


def _clipped(p: float) -> float:
    return max(0.0, min(1.0, p))


def chi2_sf(x: float | None, dof: float | None) -> float:
    if x is None or dof is None or math.isnan(x) or not dof > 0:
        return math.nan
    if x <= 0 or math.isinf(x):
        return 1.0 if x <= 0 else 0.0
    return _clipped(_gamma_upper(dof / 2.0, x / 2.0, NUMBERS))


def f_sf(f: float | None, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    if f is None or math.isnan(f) or not (d1 > 0 and d2 > 0):
        return math.nan
    if f <= 0 or math.isinf(f):
        return 1.0 if f <= 0 else 0.0
    whole = d2 + d1 * f
    return _clipped(_beta_lower(d2 / 2.0, d1 / 2.0, d2 / whole, d1 * f / whole, NUMBERS))


def kolmogorov_sf(lam: float) -> float:
    """P(K > lam) for the Kolmogorov distribution."""
    return 1.0 if lam <= 0.02 else _clipped(_kolmogorov(lam, NUMBERS))


def ks_2samp_p(d: float, n: int, m: int) -> float:
    """Asymptotic two-sided p-value of the two-sample KS statistic D (Stephens' correction)."""
    if n == 0 or m == 0:
        return math.nan
    size = math.sqrt(n * m / (n + m))
    return kolmogorov_sf((size + 0.12 + 0.11 / size) * d)
