"""Model-quality metrics: overall (A1, A2) and per group.

All metrics are algebraic aggregates, so each operator is one hash aggregate
with a map-side partial step: the shuffle carries one small row per group per
partition whatever the size of the group (a hot group costs no more than a
cold one).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, dlit, safe_div


def _r2(y: Column, p: Column) -> Column:
    """R² = 1 - SS_res / SS_tot with the zero-variance and n<2 edges (T4).

    SS_tot comes from ``var_pop`` (a mergeable, numerically stable moment)
    rather than sum(y²) - n·mean², which cancels catastrophically at scale.
    """
    n = F.count(y)
    ss_res = F.sum((y - p) * (y - p))
    ss_tot = F.var_pop(y) * n
    return (F.when(n < 2, F.lit(None).cast("double"))
            .when(ss_tot == 0, F.when(ss_res == 0, dlit(1.0)).otherwise(dlit(0.0)))
            .otherwise(dlit(1.0) - safe_div(ss_res, ss_tot)))


def regression_metric_columns(y: str | Column, p: str | Column, r2: bool = True,
                              mape: bool = True) -> list[Column]:
    y, p = col(y), col(p)
    err = p - y
    out = [
        F.avg(F.abs(err)).alias("mae"),
        F.avg(err * err).alias("mse"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
    ]
    if r2:
        out.append(_r2(y, p).alias("r2"))
    if mape:
        out.append((F.avg(F.abs(safe_div(y - p, y))) * dlit(100.0)).alias("mape"))
    return out


def regression_metrics(df: DataFrame, y: str = "salary", p: str = "predicted_salary") -> DataFrame:
    """A1: MAE, MSE, RMSE, R², MAPE % over the whole table (one row)."""
    return df.agg(F.count(F.lit(1)).alias("n"), *regression_metric_columns(y, p))


def interval_metrics(df: DataFrame, y: str, lo: str, hi: str,
                     alpha: float | None = None) -> DataFrame:
    """A2: empirical coverage of [lo, hi] and mean width (+ nominal and gap)."""
    cov = F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double"))
    cols = [F.count(F.lit(1)).alias("n"), cov.alias("coverage"),
            F.avg(F.col(hi) - F.col(lo)).alias("mean_width")]
    if alpha is not None:
        cols += [dlit(1.0 - alpha).alias("nominal"), (cov - dlit(1.0 - alpha)).alias("coverage_gap")]
    return df.agg(*cols)


def group_metrics(df: DataFrame, by: str | Sequence[str], y: str = "salary",
                  p: str = "predicted_salary", r2: bool = False,
                  extra: Mapping[str, Column] | None = None) -> DataFrame:
    """A3/A4/A5/A10: per-group count, means, MAE, MSE, RMSE, bias (and R²).

    ``by`` may name several columns (intersectional metrics). Rows whose group
    key is NULL are kept as their own group, matching SQL GROUP BY.
    ``extra`` adds user metrics as aggregate columns (the metric-dict extension point).
    """
    keys = [by] if isinstance(by, str) else list(by)
    yc, pc = F.col(y), F.col(p)
    aggs = [
        F.count(F.lit(1)).alias("count"),
        F.avg(pc).alias("mean_predicted"),
        F.avg(yc).alias("mean_actual"),
        *regression_metric_columns(yc, pc, r2=r2, mape=False),
        (F.avg(pc) - F.avg(yc)).alias("bias"),
    ]
    for name, expr in (extra or {}).items():
        aggs.append(expr.alias(name))
    return df.groupBy(*keys).agg(*aggs)


def group_interval_metrics(df: DataFrame, by: str | Sequence[str], y: str, lo: str,
                           hi: str) -> DataFrame:
    """Coverage and mean interval width per group (group-conditional coverage)."""
    keys = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double")).alias("coverage"),
        F.avg(F.col(hi) - F.col(lo)).alias("mean_width"))
