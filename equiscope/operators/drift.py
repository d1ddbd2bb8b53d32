"""Distribution drift between a reference and a current table.

All features are handled by one grouped plan: numeric features are unpivoted
to (feature, x) and categorical ones to (feature, category), so a report over
many features costs the same number of shuffles as a report over one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import dlit
from ..functions.tails import chi2_tail, ks_tail
from ..roles import DRIFT_MIN_ROWS, PSI_EMPTY_SHARE, PSI_HIGH, PSI_MODERATE, TEST_LEVEL

REF, CUR = 0, 1


def _long_numeric(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(side, feature, x) for non-null numeric values of both tables."""
    def one(df, side):
        return (df.select(F.lit(side).alias("side"), F.explode(F.array(*[
                    F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"))
                    for c in cols])).alias("fx"))
                .select("side", "fx.feature", "fx.x")
                .where(F.col("x").isNotNull() & ~F.isnan("x")))
    return one(ref, REF).unionByName(one(cur, CUR))


def long_numeric_sided(df: DataFrame, side: str, cols: Sequence[str]) -> DataFrame:
    """(side, feature, x) from ONE table whose ``side`` column is 0 (reference)
    or 1 (current): one scan instead of one per side."""
    return (df.select(F.col(side).cast("int").alias("side"), F.explode(F.array(*[
                F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"))
                for c in cols])).alias("fx"))
            .select("side", "fx.feature", "fx.x")
            .where(F.col("x").isNotNull() & ~F.isnan("x")))


def long_categorical_sided(df: DataFrame, side: str, cols: Sequence[str]) -> DataFrame:
    return (df.select(F.col(side).cast("int").alias("side"), F.explode(F.array(*[
                F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category"))
                for c in cols])).alias("fc"))
            .select("side", "fc.feature", "fc.category")
            .where(F.col("category").isNotNull()))


def _long_categorical(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    def one(df, side):
        return (df.select(F.lit(side).alias("side"), F.explode(F.array(*[
                    F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category"))
                    for c in cols])).alias("fc"))
                .select("side", "fc.feature", "fc.category")
                .where(F.col("category").isNotNull()))
    return one(ref, REF).unionByName(one(cur, CUR))


def _psi_term(a, e):
    return (a - e) * F.ln(a / e)


# ------------------------------------------------------------------------ A20
def value_counts_by_side(long: DataFrame) -> DataFrame:
    """(feature, side, x, w): the long form aggregated to distinct values first.

    Every numeric statistic below reads this table, so the source is scanned
    and shuffled once (identical subtrees reuse the one exchange) and all later
    work is on distinct values, not rows — a hot value is one row.
    """
    if "w" in long.columns:
        return long
    if {"r", "c"} <= set(long.columns):  # two-sided counts back to (side, w) rows
        return (long.select("feature", "x", F.explode(F.array(
                    F.struct(F.lit(REF).alias("side"), F.col("r").alias("w")),
                    F.struct(F.lit(CUR).alias("side"), F.col("c").alias("w")))).alias("sw"))
                .select("feature", F.col("sw.side").alias("side"), "x", F.col("sw.w").alias("w"))
                .where(F.col("w") > 0))
    return long.groupBy("feature", "side", "x").agg(F.count(F.lit(1)).alias("w"))


def value_counts_two_sided(long: DataFrame) -> DataFrame:
    """(feature, x, r, c): per distinct value, its count on the reference (r)
    and current (c) side — one aggregation from the long form. KS and PSI
    both read this table, so a report aggregates the rows once."""
    if {"r", "c"} <= set(long.columns):
        return long
    if "w" in long.columns:
        r = F.sum(F.when(F.col("side") == REF, F.col("w")).otherwise(0))
        c = F.sum(F.when(F.col("side") == CUR, F.col("w")).otherwise(0))
    else:
        r = F.count_if(F.col("side") == REF)
        c = F.count_if(F.col("side") == CUR)
    return long.groupBy("feature", "x").agg(r.cast("long").alias("r"), c.cast("long").alias("c"))


def psi_numeric(long: DataFrame, bins: int = 10, edges: str = "shared") -> DataFrame:
    """PSI per feature over equal-width bins; empty bins count as 0.0001.

    ``edges="own"`` bins each side on its own [min, max] (the reference's
    behaviour, T9); ``"shared"`` bins both sides on the combined range.
    min = max widens the range by ±0.5; the top edge falls in the last bin.

    Rows are binned as they are, in a pass for the ranges and one for the counts,
    both aggregated before the shuffle: no list of distinct values is made. Hand
    in rows that are cheap to scan twice, or counts that are at hand (``w``; ``r``, ``c``).
    """
    counted = "w" in long.columns or {"r", "c"} <= set(long.columns)
    vc = value_counts_by_side(long) if counted else long.withColumn("w", F.lit(1).cast("long"))
    key = ["feature", "side"] if edges == "own" else ["feature"]
    rng = vc.groupBy(*key).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    rng = rng.select(*key,
                     F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                     F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    norm = F.lit(float(bins)) / (F.col("hi") - F.col("lo"))
    b = F.least(F.floor((F.col("x") - F.col("lo")) * norm), F.lit(bins - 1)).cast("int")
    # the range table has one row per feature (per side): bounded, broadcast it
    side_counts = (vc.join(F.broadcast(rng), on=key)
                   .groupBy("feature", b.alias("bin"))
                   .agg(F.sum(F.when(F.col("side") == REF, F.col("w")).otherwise(0)).alias("e_cnt"),
                        F.sum(F.when(F.col("side") == CUR, F.col("w")).otherwise(0)).alias("a_cnt")))
    return _psi_from_side_counts(side_counts)


def _psi_from_side_counts(side_counts: DataFrame) -> DataFrame:
    """Σ (a-e)·ln(a/e) over the cells of each feature, shares floored at 0.0001.

    A cell empty on both sides contributes (0.0001-0.0001)·ln 1 = 0, so only
    observed cells are needed — no grid of all cells. Totals per feature are a
    one-row-per-feature aggregate, broadcast back.
    """
    tot = side_counts.groupBy("feature").agg(F.sum("e_cnt").alias("e_n"), F.sum("a_cnt").alias("a_n"))
    e = F.col("e_cnt") / F.col("e_n")
    a = F.col("a_cnt") / F.col("a_n")
    shares = side_counts.join(F.broadcast(tot), "feature").select(  # one row per feature
        "feature", F.when(e == 0, dlit(PSI_EMPTY_SHARE)).otherwise(e).alias("e"),
        F.when(a == 0, dlit(PSI_EMPTY_SHARE)).otherwise(a).alias("a"))
    return shares.groupBy("feature").agg(F.sum(_psi_term(F.col("a"), F.col("e"))).alias("psi"))


# ------------------------------------------------------------------------ A21
def category_counts(long: DataFrame) -> DataFrame:
    """(feature, side, category, cnt): the categorical long form aggregated once."""
    if "cnt" in long.columns:
        return long
    return long.groupBy("feature", "side", "category").agg(F.count(F.lit(1)).alias("cnt"))


def psi_categorical(long: DataFrame) -> DataFrame:
    """PSI over the union of categories; a category missing on a side is 0.0001."""
    counts = category_counts(long)
    side_counts = counts.groupBy("feature", "category").agg(
        F.sum(F.when(F.col("side") == REF, F.col("cnt")).otherwise(0)).alias("e_cnt"),
        F.sum(F.when(F.col("side") == CUR, F.col("cnt")).otherwise(0)).alias("a_cnt"))
    return _psi_from_side_counts(side_counts)


# ------------------------------------------------------------------------ A22
def ks_statistic(long: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Two-sample KS D per feature, with n and m, as a distributed prefix sum.

    1. counts per distinct (feature, x) and side — a hot value is one row;
    2. running totals of both sides in x order per feature
       (``prefix.running_totals``: range partitions sized from the number of
       distinct values, so a feature with many values spans many tasks);
    3. both ECDFs at every distinct value → max |F_ref - F_cur| per feature.
    """
    from pyspark import StorageLevel

    from .prefix import ROWS_PER_TASK, running_totals

    given = {"r", "c"} <= set(long.columns)  # the caller owns (and caches) it
    counts = value_counts_two_sided(long)
    if not given:
        counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
    spark = long.sparkSession
    try:
        sizes = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("d"), F.sum("r").alias("n"),
                                              F.sum("c").alias("m")).collect()  # one row per feature
        run = running_totals(counts, ["feature"], ["x"], ["r", "c"], ["cr", "cc"],
                             rows=sum(int(r["d"]) for r in sizes), key_count=len(sizes),
                             rows_per_task=rows_per_task or ROWS_PER_TASK)
    finally:
        if not given:
            counts.unpersist(blocking=True)
    tot = F.broadcast(spark.createDataFrame([(r["feature"], int(r["n"]), int(r["m"])) for r in sizes],
                                            "feature string, n long, m long"))
    rows = (run.join(tot, "feature")
            .groupBy("feature")
            .agg(F.max(F.abs(F.try_divide(F.col("cr"), F.col("n")) - F.try_divide(F.col("cc"), F.col("m")))).alias("ks_statistic"),
                 F.first("n").alias("n_ref"), F.first("m").alias("n_cur"))
            .collect())  # one row per feature
    return spark.createDataFrame([(r["feature"], float(r["ks_statistic"]), int(r["n_ref"]), int(r["n_cur"]))
                                  for r in rows],
                                 "feature string, ks_statistic double, n_ref long, n_cur long")


# ------------------------------------------------------------------------ A23
def chi2_two_sample(long: DataFrame) -> DataFrame:
    """χ² on the 2×k table (side × category) per feature; Yates when dof = 1."""
    o = category_counts(long).select("feature", F.col("side").cast("string").alias("row"),
                                     F.col("category").alias("col"), F.col("cnt").alias("o"))
    return chi2_table(o)


def chi2_table(cells: DataFrame) -> DataFrame:
    """χ² from (feature, row, col, o) cells; missing cells count as 0."""
    rows = cells.groupBy("feature", "row").agg(F.sum("o").alias("rt"))
    cols = cells.groupBy("feature", "col").agg(F.sum("o").alias("ct"))
    dims = cells.groupBy("feature").agg(F.sum("o").alias("N"),
                                         F.countDistinct("row").alias("nr"),
                                         F.countDistinct("col").alias("nc"))
    full = (rows.join(cols, "feature")
            .join(cells, ["feature", "row", "col"], "left")
            .join(dims, "feature"))
    ob = F.coalesce(F.col("o"), F.lit(0)).cast("double")
    ex = F.col("rt") * F.col("ct") / F.col("N")
    dof = (F.col("nr") - 1) * (F.col("nc") - 1)
    diff = F.abs(ob - ex)
    yates = F.when(dof == 1, F.least(dlit(0.5), diff)).otherwise(dlit(0.0))
    return (full.groupBy("feature", "nr", "nc")
            .agg(F.sum((diff - yates) * (diff - yates) / ex).alias("chi2_statistic"))
            .select("feature", "chi2_statistic",
                    ((F.col("nr") - 1) * (F.col("nc") - 1)).cast("long").alias("dof")))


def chi2_paired(df: DataFrame, a: str, b: str, feature: str | None = None) -> DataFrame:
    """Contingency of two columns of the same rows (the reference's crosstab on
    aligned rows, T8); join the two tables on their row key first (J3)."""
    cells = (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
             .groupBy(F.col(a).cast("string").alias("row"), F.col(b).cast("string").alias("col"))
             .agg(F.count(F.lit(1)).alias("o"))
             .withColumn("feature", F.lit(feature or f"{a}~{b}")))
    return chi2_table(cells)


# ------------------------------------------------------------------- A24/A25
def drift_level(psi):
    return (F.when(psi >= dlit(PSI_HIGH), F.lit("high"))
            .when(psi >= dlit(PSI_MODERATE), F.lit("moderate")).otherwise(F.lit("low")))


def numeric_drift_stats(ref: DataFrame | None, cur: DataFrame | None, cols: Sequence[str],
                        bins: int = 10, edges: str = "shared", long: DataFrame | None = None,
                        min_rows: int = DRIFT_MIN_ROWS) -> DataFrame:
    """PSI, KS, sizes and level per numeric feature (one row each).

    The rows are aggregated once into (feature, x, r, c), cached while KS and
    PSI read it, and the per-feature result is materialised before release.
    """
    from pyspark import StorageLevel

    long = long if long is not None else _long_numeric(ref, cur, cols)
    counts = value_counts_two_sided(long).persist(StorageLevel.MEMORY_AND_DISK)
    spark = counts.sparkSession
    try:
        ks = ks_statistic(counts)
        rows = (psi_numeric(value_counts_by_side(counts), bins, edges).join(ks, "feature")
                .where((F.col("n_ref") >= min_rows) & (F.col("n_cur") >= min_rows))
                .withColumn("drift_level", drift_level(F.col("psi"))).collect())  # one row per feature
    finally:
        counts.unpersist(blocking=True)
    return spark.createDataFrame(
        [(r["feature"], float(r["psi"]), float(r["ks_statistic"]), int(r["n_ref"]), int(r["n_cur"]),
          r["drift_level"]) for r in rows],
        "feature string, psi double, ks_statistic double, n_ref long, n_cur long, drift_level string")


def categorical_drift_stats(ref: DataFrame | None, cur: DataFrame | None, cols: Sequence[str],
                            long: DataFrame | None = None) -> DataFrame:
    long = long if long is not None else _long_categorical(ref, cur, cols)
    long = category_counts(long)
    sizes = long.groupBy("feature").agg(
        F.sum(F.when(F.col("side") == REF, F.col("cnt")).otherwise(0)).cast("long").alias("n_ref"),
        F.sum(F.when(F.col("side") == CUR, F.col("cnt")).otherwise(0)).cast("long").alias("n_cur"))
    return (psi_categorical(long).join(chi2_two_sample(long), "feature").join(sizes, "feature")
            .where((F.col("n_ref") >= DRIFT_MIN_ROWS) & (F.col("n_cur") >= DRIFT_MIN_ROWS))
            .withColumn("drift_level", drift_level(F.col("psi"))))


def drift_stats_table(df: DataFrame, side: str, numeric: Sequence[str], categorical: Sequence[str],
                      bins: int = 10, edges: str = "shared") -> DataFrame:
    """Per-feature drift statistics (PSI, KS / χ², levels) for a table whose
    ``side`` column marks reference (0) and current (1) rows.

    The needed columns are projected and cached once; every statistic reads
    the cache, and the result — one row per feature — is collected before the
    cache is released, so the source is scanned once for the whole report.
    """
    from pyspark import StorageLevel

    spark = df.sparkSession
    proj = df.select(side, *numeric, *categorical).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = []
        if numeric:
            num = numeric_drift_stats(None, None, numeric, bins, edges,
                                      long=long_numeric_sided(proj, side, numeric))
            rows += [(r["feature"], "numerical", r["psi"], r["ks_statistic"], None, None,
                      r["drift_level"], int(r["n_ref"]), int(r["n_cur"])) for r in num.collect()]
        if categorical:
            cat = categorical_drift_stats(None, None, categorical,
                                          long=long_categorical_sided(proj, side, categorical))
            rows += [(r["feature"], "categorical", r["psi"], None, r["chi2_statistic"], int(r["dof"]),
                      r["drift_level"], int(r["n_ref"]), int(r["n_cur"])) for r in cat.collect()]
    finally:
        proj.unpersist(blocking=True)
    return spark.createDataFrame(rows, "feature string, kind string, psi double, ks_statistic double, "
                                       "chi2_statistic double, dof long, drift_level string, "
                                       "n_ref long, n_cur long")


def significant(p: Column) -> Column:
    """p < 0.05; a p that is NaN or NULL is no evidence."""
    return F.coalesce(p < dlit(TEST_LEVEL), F.lit(False)) & ~F.isnan(F.coalesce(p, dlit(1.0)))


def drift_report(spark: SparkSession, ref: DataFrame | None, cur: DataFrame | None,
                 numeric: Sequence[str], categorical: Sequence[str], bins: int = 10,
                 edges: str = "shared", sided: tuple[DataFrame, str] | None = None
                 ) -> tuple[DataFrame, DataFrame]:
    """(per-feature table, one-row summary).

    Statistics are distributed; p-values and flags are column expressions over
    the per-feature table.
    """
    if sided is None:
        both = ref.select(*numeric, *categorical).withColumn("_side", F.lit(REF)).unionByName(
            cur.select(*numeric, *categorical).withColumn("_side", F.lit(CUR)))
        sided = both, "_side"
    table = drift_stats_table(sided[0], sided[1], numeric, categorical, bins, edges)
    p = F.when(F.col("kind") == "numerical", ks_tail(F.col("ks_statistic"), F.col("n_ref"), F.col("n_cur"))).otherwise(chi2_tail(F.col("chi2_statistic"), F.col("dof")))
    per = (table.withColumn("p_value", p)
           .withColumn("test_drift", significant(F.col("p_value")))
           .select("feature", "kind", "psi", "ks_statistic", "p_value", "chi2_statistic", "drift_level", "test_drift",
                   ((F.col("psi") >= dlit(PSI_MODERATE)) | F.col("test_drift")).alias("drifted"),
                   F.when(F.col("kind") == "numerical", F.greatest("psi", "ks_statistic")).otherwise(F.col("psi")).alias("drift_score")))
    summary = per.agg(
        F.coalesce(F.avg("drift_score"), dlit(0.0)).alias("overall_drift_score"),
        F.coalesce(F.max(F.col("drifted").cast("int")) == 1, F.lit(False)).alias("drift_detected"),
        F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("feature")))).alias("drifted_features"),
        F.count(F.lit(1)).alias("n_features"))
    return per, summary


def prediction_drift(ref: DataFrame, cur: DataFrame, p: str, bins: int = 10,
                     edges: str = "shared") -> DataFrame:
    """PSI, KS with its p-value and the verdict, means, population std, mean shift.

    One row; ``drift_detected`` is a PSI from ``PSI_MODERATE`` on or a KS p below 0.05.
    """
    st = (numeric_drift_stats(ref, cur, [p], bins, edges, min_rows=1)
          .withColumn("ks_p_value", ks_tail(F.col("ks_statistic"), F.col("n_ref"), F.col("n_cur")))
          .withColumn("drift_detected", (F.col("psi") >= dlit(PSI_MODERATE)) | significant(F.col("ks_p_value")))
          .select("psi", "ks_statistic", "ks_p_value", "drift_detected", "n_ref", "n_cur"))
    r = ref.agg(F.avg(p).alias("m"), F.stddev_pop(p).alias("s")).first()  # one-row scalars
    c = cur.agg(F.avg(p).alias("m"), F.stddev_pop(p).alias("s")).first()
    return (st.withColumn("ref_mean", dlit(r["m"])).withColumn("ref_std", dlit(r["s"]))
            .withColumn("cur_mean", dlit(c["m"])).withColumn("cur_std", dlit(c["s"]))
            .withColumn("mean_shift", dlit(c["m"] - r["m"])))


def drift_run(ref: DataFrame, cur: DataFrame, numeric: Sequence[str], categorical: Sequence[str], prediction: str,
              bins: int = 10, edges: str = "shared") -> DataFrame:
    """The whole run as one row: the features' verdict, the predictions' verdict, and both sizes."""
    _, summary = drift_report(ref.sparkSession, ref, cur, numeric, categorical, bins, edges)
    row = prediction_drift(ref, cur, prediction, bins, edges).first()  # one row, as are the sizes
    names = {"prediction_psi": "psi", "prediction_ks_statistic": "ks_statistic", "prediction_ks_p_value": "ks_p_value",
             "prediction_drift_detected": "drift_detected", "mean_shift": "mean_shift"}
    return summary.select("*", *[F.lit(row[c]).alias(name) for name, c in names.items()],
                          F.lit(ref.count()).cast("long").alias("reference_size"), F.lit(cur.count()).cast("long").alias("current_size"))
