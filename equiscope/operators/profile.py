"""Exploratory profile of a table.

Per-column statistics are computed for all columns in one pass by unpivoting
to (column, value) and grouping by column: the shuffle carries one partial
row per column per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import dlit, js_round, safe_div
from ..session import written
from . import quantile


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


# ------------------------------------------------------------------------- S9
def dataset_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, dtype, non-null and null counts; the row
    count comes from the same single aggregation."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(df.columns)]
    wide = df.agg(*aggs)
    meta = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    stack = F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("column"), F.lit(dt).alias("dtype"),
                 F.col(f"n_{i}").alias("null_count")) for i, name, dt in meta]))
    return wide.select("_rows", stack.alias("s")).select(
        "s.position", "s.column", "s.dtype", F.col("_rows").alias("rows"),
        F.lit(len(meta)).alias("columns"), "s.null_count",
        (F.col("_rows") - F.col("s.null_count")).alias("non_null_count"))


# ------------------------------------------------------------------------- E1
def missing(df: DataFrame) -> DataFrame:
    """Columns with missing values: count and % (2 dp), most missing first."""
    prof = dataset_profile(df)
    return (prof.where(F.col("null_count") > 0)
            .select("column", F.col("null_count").alias("missing_count"),
                    F.bround(F.col("null_count") * dlit(100.0) / F.col("rows"), 2).alias("missing_pct"))
            .orderBy(F.desc("missing_count"), "column"))


# ------------------------------------------------------------------------- E2
def describe_all(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """pandas ``describe(include='all')`` as a long table, one row per column.

    Numeric: count, mean, std (sample), min, quartiles (exact, linear), max.
    Categorical: count, unique, top (most frequent; ties → smallest), freq.
    """
    num_long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in numeric]))
        .alias("v")).select("v.column", "v.x").where(F.col("x").isNotNull())
    num = num_long.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"))
    # a column is one group holding every row: exact quartiles by distributed selection
    num = num.join(quantile.grouped_quantiles(num_long, ["column"], "x", [0.25, 0.5, 0.75])
                   .drop("n"), "column")
    num = num.select("column", "count", F.lit(None).cast("bigint").alias("unique"),
                     F.lit(None).cast("string").alias("top"), F.lit(None).cast("bigint").alias("freq"),
                     "mean", "std", "min", F.element_at("q", 1).alias("q25"),
                     F.element_at("q", 2).alias("q50"), F.element_at("q", 3).alias("q75"), "max")
    cat_long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in categorical]))
        .alias("c")).select("c.column", "c.v").where(F.col("v").isNotNull())
    vc = cat_long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    cat = vc.groupBy("column").agg(
        F.sum("n").cast("bigint").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("top"),
        F.max("n").alias("freq"))
    d = F.lit(None).cast("double")
    cat = cat.select("column", "count", "unique", "top", "freq", d.alias("mean"), d.alias("std"),
                     d.alias("min"), d.alias("q25"), d.alias("q50"), d.alias("q75"), d.alias("max"))
    return num.unionByName(cat)


# ------------------------------------------------------------------------- E3
def shape_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis (pandas ``skew``/``kurt``, T11)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols]))
        .alias("v")).select("v.column", "v.x").where(F.col("x").isNotNull())
    g = long.groupBy("column").agg(F.count(F.lit(1)).cast("double").alias("n"),
                                   F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"))
    n = F.col("n")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return g.select("column", skew.alias("skewness"), kurt.alias("kurtosis"))


# ------------------------------------------------------------------------- E4
def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width histogram over [min, max] (last bin closed), all bins listed."""
    x = F.col(col).cast("double")
    vals = df.select(x.alias("x")).where(F.col("x").isNotNull())
    r = vals.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()  # one-row scalars
    lo, hi = float(r["lo"]), float(r["hi"])
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    b = F.least(F.floor((F.col("x") - dlit(lo)) * (dlit(float(bins)) / (dlit(hi) - dlit(lo)))),
                F.lit(bins - 1)).cast("int")
    counts = vals.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    w = (dlit(hi) - dlit(lo)) / F.lit(float(bins))
    return (grid.join(counts, "bin", "left")
            .select("bin", (dlit(lo) + F.col("bin") * w).alias("left_edge"),
                    (dlit(lo) + (F.col("bin") + 1) * w).alias("right_edge"),
                    F.coalesce(F.col("count"), F.lit(0)).alias("count")))


# ------------------------------------------------------------------------- E5
def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


# ------------------------------------------------------------------------- E6
def box_stats(df: DataFrame, by: str, y: str) -> DataFrame:
    """Quartiles, 1.5·IQR whiskers (most extreme values inside the fences) and
    outlier counts per category, with the categories' rank by median."""
    q = quantile.grouped_quantiles(df, [by], y, [0.25, 0.5, 0.75])
    q = q.select(by, "n", F.element_at("q", 1).alias("q1"), F.element_at("q", 2).alias("median"),
                 F.element_at("q", 3).alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")) \
         .withColumn("lo_fence", F.col("q1") - 1.5 * F.col("iqr")) \
         .withColumn("hi_fence", F.col("q3") + 1.5 * F.col("iqr"))
    inside = F.col(y).between(F.col("lo_fence"), F.col("hi_fence"))
    w = (df.select(by, y).where(F.col(y).isNotNull()).join(q, by)
         .groupBy(by).agg(F.min(F.when(inside, F.col(y))).alias("whisker_low"),
                          F.max(F.when(inside, F.col(y))).alias("whisker_high"),
                          F.count_if(~inside).alias("outliers")))
    from pyspark.sql.window import Window as W
    return (q.join(w, by)
            .withColumn("median_rank", F.dense_rank().over(W.orderBy(F.desc("median"))))
            .select(by, "n", "q1", "median", "q3", "iqr", "whisker_low", "whisker_high", "outliers",
                    "median_rank"))


# ------------------------------------------------------------------------- E7
def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"),
                  F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
                  F.regr_count(F.col(y), F.col(x)).alias("n"))


# ------------------------------------------------------------------------- E8
def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson matrix as (a, b, corr) from one aggregation."""
    pairs = [(a, b) for a in cols for b in cols]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}")
                    for a, b in pairs])
    long = wide.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "corr")
    return long.select(F.split("pair", r"\|").getItem(0).alias("a"),
                       F.split("pair", r"\|").getItem(1).alias("b"), "corr")


# ------------------------------------------------------------------------- E9
def pivot_median(df: DataFrame, row: str, col: str, y: str, values: Sequence[str]) -> DataFrame:
    """Median of ``y`` per (row, col) cell, pivoted on the listed ``values``.

    Cell medians are exact per-group selections; the pivot then only moves one
    value per cell."""
    med = quantile.grouped_quantiles(df.where(F.col(col).isin(list(values))), [row, col], y, [0.5])
    rows = df.select(row).distinct()
    piv = med.groupBy(row).pivot(col, list(values)).agg(F.first(F.element_at("q", 1)))
    return rows.join(piv, row, "left")


# ------------------------------------------------------------------------ E10
def group_means(df: DataFrame, by: str, y: str, digits: int = 0) -> DataFrame:
    return df.groupBy(by).agg(F.bround(F.avg(y), digits).alias(f"mean_{y}"),
                              F.count(F.lit(1)).alias("count"))


# ------------------------------------------------------------------------ E11
def iqr_outliers(df: DataFrame, y: str, by: str) -> tuple[DataFrame, DataFrame]:
    """(summary row, outlier counts by ``by``) with exact global quartiles
    from distributed selection (no single-task percentile map)."""
    q1, q3 = quantile.quantiles_linear(df, y, [0.25, 0.75])
    iqr = q3 - q1
    lo, hi = q1 - 1.5 * iqr, q3 + 1.5 * iqr
    out = F.col(y) < dlit(lo)
    out = out | (F.col(y) > dlit(hi))
    flagged = df.where(F.col(y).isNotNull()).withColumn("_out", out)
    summary = flagged.agg(
        dlit(q1).alias("q1"), dlit(q3).alias("q3"), dlit(iqr).alias("iqr"),
        dlit(lo).alias("lower_bound"), dlit(hi).alias("upper_bound"),
        F.count_if("_out").alias("outliers"),
        F.bround(F.count_if("_out") * dlit(100.0) / F.count(F.lit(1)), 2).alias("outlier_pct"),
        F.min(F.when(F.col("_out"), F.col(y))).alias("outlier_min"),
        F.max(F.when(F.col("_out"), F.col(y))).alias("outlier_max"))
    by_group = flagged.where("_out").groupBy(by).agg(F.count(F.lit(1)).alias("outliers"))
    return summary, by_group


# ------------------------------------------------------------------------ E12
def qq_points(df: DataFrame, col: str, chunk: int = 100_000,
              rows_per_task: int | None = None) -> DataFrame:
    """Normal Q-Q pairs: ordered value vs Φ⁻¹ of Filliben's order-statistic medians.

    Ranks come from a distributed prefix sum over the *distinct* values and
    their counts (``prefix.running_totals``), so a hot value is one row there.
    Each value then owns the rank range [cum - cnt, cum); the range is cut
    into chunks of ≤ ``chunk`` ranks, the chunk descriptors are spread over
    tasks by a hash repartition, and each chunk is expanded with ``sequence``
    — no task expands more than ``chunk`` rows. Tied values are
    interchangeable, so the (rank, value) pairs are exact. Φ⁻¹ is a JVM
    column expression (``functions.normal``), not a Python UDF.
    """
    from ..functions.normal import normal_ppf
    from .prefix import ROWS_PER_TASK, running_totals

    x = F.col("value")
    vc = written(df.select(F.col(col).cast("double").alias("value")).where(x.isNotNull() & ~F.isnan(x))
                 .groupBy("value").agg(F.count(F.lit(1)).alias("cnt")))  # read by the count, the bounds and the ranges
    st = vc.agg(F.count(F.lit(1)).alias("d"), F.sum("cnt").alias("n")).first()  # one row
    if not st["d"]:
        return df.sparkSession.createDataFrame([], "rank long, value double, theoretical double")
    total = int(st["n"])
    run = running_totals(vc, [], ["value"], ["cnt"], ["cum"], rows=int(st["d"]),
                         rows_per_task=rows_per_task or ROWS_PER_TASK)
    first = F.col("cum") - F.col("cnt")
    c = F.lit(chunk).cast("long")
    chunks = (run.select("value", first.alias("r0"), F.col("cum").alias("r1"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("cnt") - 1) / c)
                                              .cast("long"))).alias("k"))
              .repartition("value", "k"))
    lo = F.col("r0") + F.col("k") * c
    hi = F.least(lo + c, F.col("r1")) - 1
    ranked = chunks.select(F.explode(F.sequence(lo, hi)).alias("rank"), "value")
    n = F.lit(float(total))
    i = F.col("rank").cast("double") + 1.0
    last = F.pow(dlit(0.5), dlit(1.0) / n)
    m = (F.when(F.col("rank") == 0, dlit(1.0) - last)
         .when(F.col("rank") == F.lit(total - 1), last)
         .otherwise((i - 0.3175) / (n + 0.365)))
    return ranked.select("rank", "value", normal_ppf(m).alias("theoretical"))


# ------------------------------------------------------------------- helpers
def rounded_average(c) -> "F.Column":
    return js_round(F.avg(c))


__all__ = ["dataset_profile", "missing", "describe_all", "shape_stats", "histogram",
           "value_counts", "box_stats", "trend", "correlations", "pivot_median", "group_means",
           "iqr_outliers", "qq_points", "safe_div"]
