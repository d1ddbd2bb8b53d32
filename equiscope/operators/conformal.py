"""Split-conformal prediction intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dlit
from . import quantile


def conformal_rank(n: int, alpha: float) -> int:
    """0-based order statistic NumPy's "higher" quantile at ceil((n+1)(1-α))/n picks."""
    if n <= 0:
        raise ValueError("empty calibration set")
    k = math.ceil((n + 1) * (1 - alpha))
    if k > n:
        raise ValueError(f"calibration set too small for alpha={alpha}: need n ≥ {k}, got {n}")
    return min(k, n - 1)


def conformal_quantile(cal: DataFrame, y: str, p: str, alpha: float = 0.1) -> tuple[float, int]:
    """q_hat from absolute residuals on the calibration rows, and n.

    The order statistic is selected distributed (histogram refinement); no
    sort of the whole calibration set and no single-task percentile map.
    """
    scores = cal.select(F.abs(F.col(y) - F.col(p)).alias("score"))
    return quantile.value_at_rank(scores, "score", lambda n: conformal_rank(n, alpha))


def apply_intervals(df: DataFrame, p: str, q_hat: float | Column, clamp: bool = False,
                    lo: str = "lower_bound", hi: str = "upper_bound") -> DataFrame:
    """p ± q_hat; unclamped for evaluation, clamped at 0 for serving."""
    q = q_hat if isinstance(q_hat, Column) else dlit(q_hat)
    low = F.col(p) - q
    if clamp:
        low = F.greatest(dlit(0.0), low)
    return df.withColumn(lo, low).withColumn(hi, F.col(p) + q) \
             .withColumn("interval_width", F.col(hi) - F.col(lo))


def conformal_summary(df: DataFrame, split: str, y: str, p: str, alpha: float = 0.1,
                      cal_value: str = "calibration", test_value: str = "test") -> DataFrame:
    """A28 summary row: q_hat from the calibration rows, coverage on both sets.

    ``split`` names a column whose value marks calibration / test rows (rows
    of any other value, e.g. training, are ignored). One aggregation computes
    both coverages after q_hat is known.
    """
    q_hat, _ = conformal_quantile(df.where(F.col(split) == cal_value), y, p, alpha)
    iv = apply_intervals(df.where(F.col(split).isin(cal_value, test_value)), p, q_hat)
    cov = F.col(y).between(F.col("lower_bound"), F.col("upper_bound")).cast("double")
    is_cal = F.col(split) == cal_value
    is_test = F.col(split) == test_value
    test_cov = F.avg(F.when(is_test, cov))
    return iv.agg(
        dlit(alpha).alias("alpha"),
        dlit(1.0 - alpha).alias("nominal_coverage"),
        dlit(q_hat).alias("q_hat"),
        F.count(F.when(is_cal, 1)).alias("calibration_size"),
        F.count(F.when(is_test, 1)).alias("test_size"),
        F.avg(F.when(is_cal, cov)).alias("calibration_coverage"),
        test_cov.alias("test_coverage"),
        (test_cov - dlit(1.0 - alpha)).alias("test_coverage_gap"),
        F.avg(F.when(is_test, F.col("interval_width"))).alias("avg_interval_width"))
