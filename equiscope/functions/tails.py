"""Upper tails of the χ², F and Kolmogorov distributions as JVM column expressions.

Both the gamma and the beta density, written over the logarithm (the logit) of
their variable, are log-concave and analytic. A tail is therefore the density
at the statistic times ``∫ exp(-drop(y)) dy``, where ``drop`` is how far the log
density has fallen ``y`` beyond the statistic, away from the mode. A quadratic
bound of ``drop``, halved while that loses nothing, says where nothing is left
to add (``_NEGLIGIBLE``), and Gauss-Legendre panels over that stretch give twelve digits for any degrees of
freedom: there is no iteration, no switch of form with size, and so no row that
fails to converge. The side that holds less than about half is integrated, the
other is its complement.

The density itself is taken relative to its mode, with Stirling's remainder in
place of log-gammas, so that large parameters lose no digits.

Every formula is written once over a small set of operations: ``COLUMNS``
renders it as a Spark expression, ``NUMBERS`` evaluates it on the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_NEGLIGIBLE = 40.0  # e^-40: below the last digit of what is summed
_PANELS, _POINTS = 16, 16
_x, _w = np.polynomial.legendre.leggauss(_POINTS)
#: Places in (0, 1) and their weights.
NODES = [(float((k + (x + 1) / 2) / _PANELS), float(w / 2 / _PANELS)) for k in range(_PANELS) for x, w in zip(_x, _w)]
_HALVINGS = 8
_TERMS = 12  # of either Kolmogorov series, on its side of 1


class COLUMNS:
    exp, log1p, expm1, sqrt, least, greatest = F.exp, F.log1p, F.expm1, F.sqrt, F.least, F.greatest
    number = staticmethod(lambda x: F.lit(float(x)))

    @staticmethod
    def choose(condition, yes, no):
        return F.when(condition, yes).otherwise(no)

    @staticmethod
    def bind(f, *values):
        """``f`` of values that are evaluated once a row, however often ``f`` names them."""
        named = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
        return F.transform(F.array(named), lambda s: f(*[s[f"v{i}"] for i in range(len(values))]))[0]

    @staticmethod
    def integral(f):
        nodes = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in NODES])
        return F.aggregate(nodes, F.lit(0.0), lambda total, node: total + node["w"] * f(node["x"]))

    @staticmethod
    def shortened(far, drop):
        return F.aggregate(F.sequence(F.lit(1), F.lit(_HALVINGS)), far, lambda y, _: F.when(drop(y * 0.5) >= _NEGLIGIBLE, y * 0.5).otherwise(y))


class NUMBERS:
    exp, log1p, sqrt, least, greatest = math.exp, math.log1p, math.sqrt, min, max
    number = float

    @staticmethod
    def choose(condition, yes, no):
        return yes if condition else no

    @staticmethod
    def bind(f, *values):
        return f(*values)

    @staticmethod
    def integral(f):
        return math.fsum(w * f(x) for x, w in NODES)

    @staticmethod
    def expm1(x):
        return math.expm1(min(x, 709.0))  # as good as infinite here

    @staticmethod
    def shortened(far, drop):
        for _ in range(_HALVINGS):
            far = far / 2 if drop(far / 2) >= _NEGLIGIBLE else far
        return far


def _stirling(z, m):
    """What Stirling's formula leaves of ln Γ(z), for z > 0: ten steps up, where seven terms suffice."""
    def rest(z, inverse, square):
        total = m.number(0)
        for c in (1 / 156, -691 / 360360, 1 / 1188, -1 / 1680, 1 / 1260, -1 / 360, 1 / 12):
            total = total * square + m.number(c)
        total = total * inverse
        for k in range(10):
            at = z + m.number(k)
            total = total + (at + m.number(0.5)) * m.log1p(m.number(1) / at) - m.number(1)
        return total

    inverse = m.number(1) / (z + m.number(10))
    return m.bind(rest, z, inverse, inverse * inverse)


def _reach(slope, curve, m):
    """A ``y`` by which ``slope y + curve y² / (2 + y)``, a lower bound of the drop, has reached ``_NEGLIGIBLE``."""
    a, b = slope + curve, slope * m.number(2) - m.number(_NEGLIGIBLE)
    return (m.sqrt(b * b + a * m.number(8 * _NEGLIGIBLE)) - b) / (a * m.number(2))


def _tail(density, slope, curve, drop, m):
    """``density`` times the integral of ``exp(-drop)`` from 0 to where nothing is left."""
    far = m.shortened(m.bind(lambda s, c: _reach(s, c, m), slope, curve), drop)
    return density * m.bind(lambda far: far * m.integral(lambda u: m.exp(-drop(u * far))), far)


def _gamma_upper(a, x, m):
    """Q(a, x) for a, x > 0."""
    def tail(a, x, off, sign):
        density = m.exp(a * (m.log1p(off) - off) - _stirling(a, m)) * m.sqrt(a / m.number(2 * math.pi))
        # both ways the drop is at least |x - a| y + x y² / (2 + y)
        part = _tail(density, (x - a) * sign, x, lambda y: x * m.expm1(sign * y) - sign * a * y, m)
        return m.choose(sign > m.number(0), part, m.number(1) - part)

    return m.bind(tail, a, x, (x - a) / a, m.choose(x >= a, m.number(1), m.number(-1)))


def _beta_lower(a, b, p, q, m):
    """I_p(a, b) for a, b > 0 and 0 < p < 1, q = 1 - p given apart so that neither loses digits."""
    def part(a, b, p, q, lean):
        density = m.exp(a * m.log1p(-lean / a) + b * m.log1p(lean / b) + _stirling(a + b, m) - _stirling(a, m) - _stirling(b, m)) \
            * m.sqrt(a / (a + b) * b / m.number(2 * math.pi))

        def drop(y):  # two forms of one value: the smaller parameter multiplies y
            return m.choose(a < b, a * y + (a + b) * m.log1p(p * m.expm1(-y)), (a + b) * m.log1p(q * m.expm1(y)) - b * y)

        return _tail(density, lean, (a + b) * p * q, drop, m)

    def side(a, b, p, q):
        swap = p * b > q * a  # beyond the mean: the complement is the tail
        low = m.bind(lambda a, b, p, q: part(a, b, p, q, q * a - p * b),
                     m.choose(swap, b, a), m.choose(swap, a, b), m.choose(swap, q, p), m.choose(swap, p, q))
        return m.choose(swap, m.number(1) - low, low)

    return m.bind(side, a, b, p, q)


def _kolmogorov(lam, m):
    """P(K > lam) for lam > 0: the alternating series from 1 on, below it the complement's (theta) series."""
    far, near = m.greatest(lam, m.number(1)), m.least(lam, m.number(1))
    above, below = m.number(0), m.number(0)
    for k in range(1, _TERMS + 1):
        above = above + m.number(2.0 if k % 2 else -2.0) * m.exp(m.number(-2.0 * k * k) * far * far)
        below = below + m.exp(m.number(-((2 * k - 1) * math.pi) ** 2 / 8) / (near * near))
    return m.choose(lam >= m.number(1), above, m.number(1) - below * m.number(math.sqrt(2 * math.pi)) / near)


def _clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def chi2_tail(x: Column, dof: Column) -> Column:
    """P(χ²(dof) > x). NULL for NULL; NaN where x is NaN or dof is not positive."""
    x, dof = x.cast("double"), dof.cast("double")
    inside = F.when(F.isnan(x) | F.isnan(dof) | (dof <= 0), float("nan")).when(x <= 0, 1.0).when(x == float("inf"), 0.0)
    return F.when(x.isNotNull() & dof.isNotNull(), inside.otherwise(_clipped(_gamma_upper(dof / 2.0, x / 2.0, COLUMNS))))


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """P(F(d1, d2) > f). NULL for NULL; NaN where f is NaN or a degree of freedom is not positive."""
    f, d1, d2 = f.cast("double"), d1.cast("double"), d2.cast("double")
    whole = d2 + d1 * f
    tail = _clipped(_beta_lower(d2 / 2.0, d1 / 2.0, d2 / whole, d1 * f / whole, COLUMNS))
    inside = F.when(F.isnan(f) | (d1 <= 0) | (d2 <= 0), float("nan")).when(f <= 0, 1.0).when(f == float("inf"), 0.0)
    return F.when(f.isNotNull() & d1.isNotNull() & d2.isNotNull(), inside.otherwise(tail))


def kolmogorov_tail(lam: Column) -> Column:
    """P(K > lam). NULL for NULL, NaN for NaN."""
    lam = lam.cast("double")
    inside = F.when(F.isnan(lam), float("nan")).when(lam <= 0.02, 1.0)  # below, 1 to the last digit
    return F.when(lam.isNotNull(), inside.otherwise(_clipped(_kolmogorov(lam, COLUMNS))))


def ks_tail(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p of the two-sample KS statistic: effective size n·m / (n + m), Stephens' correction. NaN if a side is empty."""
    n, m = n.cast("double"), m.cast("double")
    size = F.sqrt(n * F.try_divide(m, n + m))
    lam = (size + 0.12 + F.try_divide(F.lit(0.11), size)) * d
    return F.when(n.isNotNull() & m.isNotNull(), F.when((n <= 0) | (m <= 0), float("nan")).otherwise(kolmogorov_tail(lam)))
