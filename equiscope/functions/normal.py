"""Standard normal quantile function Φ⁻¹ as a JVM column expression.

Wichura's algorithm AS241 (PPND16, Applied Statistics 37(3), 1988): a rational
approximation in three regions, accurate to about 1e-16 — the algorithm the
Python standard library uses for ``NormalDist.inv_cdf``. Written once as
coefficient lists and rendered both as a Spark ``Column`` (whole-stage
codegen, no Python on the row path) and as SQL text for the DuckDB oracle, so
both engines evaluate the same operations in the same order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# AS241 coefficients, highest power first (Horner order).
# Central region |p - 0.5| <= 0.425, r = 0.180625 - q^2
CENTRAL_NUM = (2.5090809287301226727e+3, 3.3430575583588128105e+4, 6.7265770927008700853e+4,
               4.5921953931549871457e+4, 1.3731693765509461125e+4, 1.9715909503065514427e+3,
               1.3314166789178437745e+2, 3.3871328727963666080e+0)
CENTRAL_DEN = (5.2264952788528545610e+3, 2.8729085735721942674e+4, 3.9307895800092710610e+4,
               2.1213794301586595867e+4, 5.3941960214247511077e+3, 6.8718700749205790830e+2,
               4.2313330701600911252e+1, 1.0)
# Intermediate tail, r = sqrt(-log(min(p, 1-p))) - 1.6 for r <= 5
MID_NUM = (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
           1.27045825245236838258e+0, 3.64784832476320460504e+0, 5.76949722146069140550e+0,
           4.63033784615654529590e+0, 1.42343711074968357734e+0)
MID_DEN = (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
           1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e+0,
           2.05319162663775882187e+0, 1.0)
# Far tail, r = sqrt(-log(min(p, 1-p))) - 5 for r > 5
FAR_NUM = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
           2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e+0,
           5.46378491116411436990e+0, 6.65790464350110377720e+0)
FAR_DEN = (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
           7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
           5.99832206555887937690e-1, 1.0)


def _horner(coefs, r: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * r + F.lit(c)
    return acc


def normal_ppf(p: Column) -> Column:
    """Φ⁻¹(p) for 0 < p < 1; NaN outside, NULL for NULL."""
    q = p - F.lit(0.5)
    rc = F.lit(0.180625) - q * q
    central = q * _horner(CENTRAL_NUM, rc) / _horner(CENTRAL_DEN, rc)
    t = F.sqrt(-F.ln(F.least(p, F.lit(1.0) - p)))
    rm, rf = t - F.lit(1.6), t - F.lit(5.0)
    tail = F.when(t <= F.lit(5.0), _horner(MID_NUM, rm) / _horner(MID_DEN, rm)) \
            .otherwise(_horner(FAR_NUM, rf) / _horner(FAR_DEN, rf))
    return (F.when(p.isNull(), F.lit(None).cast("double"))
            .when((p <= F.lit(0.0)) | (p >= F.lit(1.0)), F.lit(float("nan")))
            .when(F.abs(q) <= F.lit(0.425), central)
            .when(q < F.lit(0.0), -tail)
            .otherwise(tail))


def _horner_sql(coefs, r: str) -> str:
    acc = f"CAST({coefs[0]!r} AS DOUBLE)"
    for c in coefs[1:]:
        acc = f"({acc} * {r} + CAST({c!r} AS DOUBLE))"
    return acc


def normal_ppf_sql(p: str) -> str:
    """The same expression as SQL text over the SQL expression ``p`` (0 < p < 1)."""
    q = f"(({p}) - 0.5)"
    rc = f"(0.180625 - {q} * {q})"
    t = f"sqrt(-ln(least(({p}), 1.0 - ({p}))))"
    rm, rf = f"({t} - 1.6)", f"({t} - 5.0)"
    tail = (f"(CASE WHEN {t} <= 5.0 THEN {_horner_sql(MID_NUM, rm)} / {_horner_sql(MID_DEN, rm)} "
            f"ELSE {_horner_sql(FAR_NUM, rf)} / {_horner_sql(FAR_DEN, rf)} END)")
    return (f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {_horner_sql(CENTRAL_NUM, rc)} / "
            f"{_horner_sql(CENTRAL_DEN, rc)} WHEN {q} < 0.0 THEN -{tail} ELSE {tail} END)")
