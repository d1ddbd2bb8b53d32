"""Fairness audit operators.

Shape of every operator: one scan that produces a *small* per-group table
(partial aggregation before the shuffle, so a hot group costs one row per
map task), followed by a second, tiny aggregation across groups. Scalars that
every row needs (the median threshold, the overall mean) are joined as
one-row frames, whose size is bounded by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import dlit, safe_div
from ..functions.tails import f_tail
from ..roles import (AUDIT_GAP, AUDIT_RECOMMENDATIONS, CALIBRATE_TEXT, DP_REVIEW, DP_WARNING, FOUR_FIFTHS,
                     MEAN_DIFF_REVIEW, MEAN_DIFF_WARNING, PROXY_CORR_THRESHOLD, PROXY_P_THRESHOLD, REVIEW_TEXT)
from ..session import written
from . import quantile
from .prefix import BROADCAST_ROWS, ROWS_PER_TASK, running_totals


# --------------------------------------------------------------------------- A7
def median_threshold(df: DataFrame, y: str = "salary") -> float:
    """Exact median of the target (distributed selection, no single-task map)."""
    t = quantile.median(df, y)
    if t is None:
        raise ValueError("no non-null target values")
    return t


def binarize(df: DataFrame, threshold: float | Column, y: str = "salary",
             p: str = "predicted_salary") -> DataFrame:
    """Truth and prediction binarised with ``>=`` against one shared threshold."""
    t = dlit(threshold) if not isinstance(threshold, Column) else threshold
    return df.withColumn("y_bin", (F.col(y) >= t).cast("int")) \
             .withColumn("p_bin", (F.col(p) >= t).cast("int"))


# ------------------------------------------------------------------- long form
def attribute_groups(attrs: Sequence[str]) -> Column:
    """One (attribute, group) struct per attribute, to be exploded.

    Exploding is a map-side ``Generate``: all attributes are audited in one
    scan and one shuffle instead of one pass per attribute.
    """
    return F.explode(F.array(*[
        F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("group"))
        for a in attrs]))


def group_rates(df: DataFrame, attrs: Sequence[str], y: str = "salary",
                p: str = "predicted_salary") -> DataFrame:
    """Per (attribute, group): counts, selection rate, TPR, FPR and error metrics.

    Expects ``y_bin`` / ``p_bin`` columns (``binarize``). TPR with no positives
    and FPR with no negatives are 0 (T5).
    """
    e = F.col(p) - F.col(y)
    pos = F.sum(F.col("y_bin"))
    neg = F.sum(1 - F.col("y_bin"))
    return (df.select(attribute_groups(attrs).alias("ag"), y, p, "y_bin", "p_bin")
            .select("ag.attribute", "ag.group", y, p, "y_bin", "p_bin")
            .groupBy("attribute", "group")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.avg(F.col("p_bin").cast("double")).alias("selection_rate"),
                 F.coalesce(safe_div(F.sum(F.col("p_bin") * F.col("y_bin")).cast("double"), pos),
                            dlit(0.0)).alias("tpr"),
                 F.coalesce(safe_div(F.sum(F.col("p_bin") * (1 - F.col("y_bin"))).cast("double"), neg),
                            dlit(0.0)).alias("fpr"),
                 F.avg(p).alias("mean_predicted"),
                 F.avg(y).alias("mean_actual"),
                 F.avg(F.abs(e)).alias("mae"),
                 F.avg(e * e).alias("mse"),
                 F.sqrt(F.avg(e * e)).alias("rmse"),
                 (F.avg(p) - F.avg(y)).alias("bias")))


def disparities(rates: DataFrame) -> DataFrame:
    """A8, A9, A11, A12 per attribute from the per-group table.

    dp_difference = max-min selection rate, dp_ratio = min/max (NULL if max=0);
    eo_difference = max(TPR gap, FPR gap); eo_ratio = min(TPR ratio, FPR ratio);
    four_fifths = dp_ratio >= 0.8; mean_prediction_difference = max-min mean
    prediction. Groups with a NULL key take part, as in the reference's groupby
    on a category (NULL labels are dropped there: filter them first if wanted).
    """
    r = F.col
    return (rates.groupBy("attribute")
            .agg(F.count(F.lit(1)).alias("n_groups"),
                 (F.max("selection_rate") - F.min("selection_rate")).alias("dp_difference"),
                 safe_div(F.min("selection_rate"), F.max("selection_rate")).alias("dp_ratio"),
                 F.greatest(F.max("tpr") - F.min("tpr"), F.max("fpr") - F.min("fpr")).alias("eo_difference"),
                 F.least(safe_div(F.min("tpr"), F.max("tpr")),
                         safe_div(F.min("fpr"), F.max("fpr"))).alias("eo_ratio"),
                 (F.max("mean_predicted") - F.min("mean_predicted")).alias("mean_prediction_difference"))
            .withColumn("four_fifths_pass", r("dp_ratio") >= dlit(FOUR_FIFTHS)))


def fairness_metrics(df: DataFrame, attrs: Sequence[str], y: str = "salary",
                     p: str = "predicted_salary", threshold: float | None = None,
                     drop_null_groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """(per-group table, per-attribute disparity table) for several attributes.

    The threshold defaults to the exact median of ``y`` over all rows (A7).
    """
    if threshold is None:
        threshold = median_threshold(df, y)
    rates = group_rates(binarize(df, threshold, y, p), attrs, y, p)
    if drop_null_groups:
        rates = rates.where(F.col("group").isNotNull())
    return rates, disparities(rates)


# ------------------------------------------------------------------------ A13
def fairness_status(disp: DataFrame) -> DataFrame:
    """Status per attribute: WARNING if |dp|>0.1 or |mean diff|>50000; REVIEW if
    |dp|>0.05 or |mean diff|>20000; else PASS; with recommendation texts."""
    dp = F.abs(F.coalesce(F.col("dp_difference"), dlit(0.0)))
    md = F.abs(F.coalesce(F.col("mean_prediction_difference"), dlit(0.0)))
    status = (F.when((dp > dlit(DP_WARNING)) | (md > dlit(MEAN_DIFF_WARNING)), F.lit("WARNING"))
              .when((dp > dlit(DP_REVIEW)) | (md > dlit(MEAN_DIFF_REVIEW)), F.lit("REVIEW"))
              .otherwise(F.lit("PASS")))
    dp_txt = F.format_string("%.3f", F.coalesce(F.col("dp_difference"), dlit(0.0)))
    recs = F.filter(F.array(
        F.when(F.col("status") != "PASS",
               F.concat(F.lit(REVIEW_TEXT), F.col("attribute"), F.lit(" fairness: DP difference = "), dp_txt)),
        F.when(dp > dlit(DP_WARNING),
               F.concat(F.lit(CALIBRATE_TEXT), F.col("attribute")))),
        lambda x: x.isNotNull())
    return disp.withColumn("status", status).withColumn("recommendations", recs)


def overall_status(status: DataFrame) -> DataFrame:
    """One row: REVIEW if any attribute is not PASS (never WARNING), UNKNOWN if none."""
    return status.agg(
        F.when(F.count(F.lit(1)) == 0, F.lit("UNKNOWN"))
         .when(F.max((F.col("status") != "PASS").cast("int")) == 1, F.lit("REVIEW"))
         .otherwise(F.lit("PASS")).alias("overall_status"),
        F.count(F.lit(1)).alias("n_attributes"),
        F.flatten(F.collect_list(F.when(F.col("status") != "PASS", F.col("recommendations"))))
         .alias("recommendations"))


# ------------------------------------------------------------------------ S11
def report_lines(status: DataFrame, rates: DataFrame) -> DataFrame:
    """The exported audit report as (``section``, ``position`` from 1, ``line``), each line a CSV record.

    Sections: ``1 status`` (the overall status), ``2 attributes`` (status, gaps
    and recommendations, "None" without), ``3 groups`` (metrics; whole amounts
    rounded half up, "N/A" where a metric is missing or 0), ``4 recommendations``
    (numbered, of all attributes that don't pass). Ordered by attribute, group.
    ``status`` is ``fairness_status``'s table, ``rates`` the groups'.
    """
    quoted = lambda x: F.concat(F.lit('"'), F.regexp_replace(x, '"', '""'), F.lit('"'))
    fixed = lambda x, d: F.format_string(f"%.{d}f", F.coalesce(F.col(x), dlit(0.0)))
    whole = lambda x: F.floor(F.col(x) + dlit(0.5)).cast("string")
    known = lambda x, shown: F.when(F.col(x) != 0, shown).otherwise(F.lit("N/A"))
    advice = F.array_join("recommendations", "; ")
    rows = [
        overall_status(status).select(F.lit("1 status").alias("section"), F.lit("").alias("_a"), F.lit("").alias("_b"), F.lit(0).alias("_c"),
                                      F.concat(F.lit("Overall Status,"), "overall_status").alias("line")),
        status.select(F.lit("2 attributes"), "attribute", F.lit(""), F.lit(0),
                      F.concat_ws(",", "attribute", "status", fixed("dp_difference", 4), fixed("mean_prediction_difference", 2),
                                  quoted(F.when(advice == "", F.lit("None")).otherwise(advice)))),
        rates.select(F.lit("3 groups"), "attribute", "group", F.lit(0),
                     F.concat_ws(",", "attribute", quoted(F.col("group")), F.col("count").cast("string"), whole("mean_predicted"), known("mean_actual", whole("mean_actual")),
                                 known("mae", fixed("mae", 2)), known("rmse", fixed("rmse", 2)), whole("bias"))),
        status.where("status <> 'PASS'").select("attribute", F.posexplode("recommendations"))
        .select(F.lit("4 recommendations"), "attribute", F.lit(""), "pos", quoted(F.col("col"))),
    ]
    out = rows[0]
    for part in rows[1:]:
        out = out.union(part)
    place = F.row_number().over(W.partitionBy("section").orderBy("_a", "_b", "_c"))  # a row per attribute, group or recommendation
    numbered = F.when(F.col("section") == "4 recommendations", F.concat_ws(",", F.col("position").cast("string"), "line")).otherwise(F.col("line"))
    return out.withColumn("position", place).select("section", "position", numbered.alias("line"))


# ------------------------------------------------------------------------- A6
def audit_cube(df: DataFrame, attrs: Sequence[str], y: str = "salary",
               p: str = "predicted_salary") -> DataFrame:
    """Overall, per-attribute and intersection metrics in one scan (``cube``)."""
    e = F.col(p) - F.col(y)
    return (df.cube(*attrs)
            .agg(F.grouping_id().alias("grouping_id"),
                 F.count(F.lit(1)).alias("count"),
                 F.avg(p).alias("mean_predicted"),
                 F.avg(y).alias("mean_actual"),
                 F.avg(F.abs(e)).alias("mae"),
                 F.sqrt(F.avg(e * e)).alias("rmse"),
                 (F.avg(p) - F.avg(y)).alias("bias")))


# ----------------------------------------------------------------------- A16
def mean_match(df: DataFrame, p: str, g: str, out: str = "calibrated") -> DataFrame:
    """Shift each group's predictions so the group mean equals the overall mean.

    Group means are a grouped aggregate, written once and joined back (one row
    per group; broadcast when they are counted to be few, a shuffle join
    otherwise, where a group is one task's); the overall mean follows from it. Rows whose group is NULL are left untouched.
    """
    sums = written(df.groupBy(g).agg(F.avg(p).alias("_gmean"), F.sum(F.col(p).cast("double")).alias("_sum"), F.count(p).alias("_n")))
    one = sums.agg(F.count(F.lit(1)).alias("groups"), F.sum("_sum").alias("sum"), F.sum("_n").alias("n")).first()
    overall = one["sum"] / one["n"] if one["n"] else None
    gm = sums.where(F.col(g).isNotNull()).select(g, "_gmean")
    return (df.join(F.broadcast(gm) if one["groups"] <= BROADCAST_ROWS else gm, on=g, how="left")
            .withColumn(out, F.when(F.col("_gmean").isNull(), F.col(p))
                        .otherwise(F.col(p) + dlit(overall) - F.col("_gmean")))
            .drop("_gmean"))


# ----------------------------------------------------------------------- A17
def quantile_match(df: DataFrame, p: str, g: str, out: str = "calibrated",
                   rows_per_task: int | None = None) -> DataFrame:
    """Map each prediction to the overall distribution at its within-group rank.

    u = percent rank of the prediction in its group = (#group values below
    it) / (n_g - 1), 0 for a one-row group; the calibrated value is the
    overall linear (NumPy default) quantile at u: with h = u·(N-1) and s the
    sorted predictions of all rows, s[⌊h⌋] + (h-⌊h⌋)·(s[⌈h⌉] - s[⌊h⌋]).
    Rows with a NULL group or prediction are left unchanged. Exact.

    Plan (no group or value is gathered in one task):

    * counts per distinct (group, value) and per distinct value — a hot value
      is one row;
    * "values below" per group and the start index of every distinct value
      overall are running sums (``prefix.running_totals``, range partitions);
    * s[i] for the needed indices i = ⌊h⌋, ⌈h⌉: the value starting at or
      before i, found as a running max over (value starts ∪ needed indices)
      in index order — values grow with their start index;
    * the answer per distinct (group, value) is joined back to the rows.
    """
    rpt = rows_per_task or ROWS_PER_TASK
    v = F.col("_v")
    vals = (df.select(F.col(g).alias("_g"), F.col(p).cast("double").alias("_v"))
            .where(v.isNotNull() & ~F.isnan(v)))
    counts = written(vals.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_c")))  # the one scan of the rows besides the last join
    ovc = written(counts.groupBy("_v").agg(F.sum("_c").alias("_c")))
    gvc = counts.where(F.col("_g").isNotNull())
    st = ovc.agg(F.count(F.lit(1)).alias("d"), F.sum("_c").alias("n")).first()  # one row
    if not st["d"]:
        return df.withColumn(out, F.col(p))
    n_all = int(st["n"])
    ng = written(gvc.groupBy("_g").agg(F.sum("_c").alias("_ng")))  # one row per group
    groups = ng.count()
    gcum = running_totals(gvc, ["_g"], ["_v"], ["_c"], ["_cum"], rows_per_task=rpt, key_count=groups)
    u = F.coalesce(F.try_divide((F.col("_cum") - F.col("_c")).cast("double"),
                                F.nullif(F.col("_ng") - 1, F.lit(0)).cast("double")), dlit(0.0))
    h = (gcum.join(F.broadcast(ng) if groups <= BROADCAST_ROWS else ng, "_g")
         .select("_g", "_v", (u * dlit(float(n_all - 1))).alias("_h"))
         .withColumn("_lo", F.floor("_h").cast("long")).withColumn("_hi", F.ceil("_h").cast("long")))
    starts = (running_totals(ovc, [], ["_v"], ["_c"], ["_cum"], rows=int(st["d"]), rows_per_task=rpt)
              .select((F.col("_cum") - F.col("_c")).alias("_i"), F.lit(0).alias("_kind"), "_v"))
    h = written(h)  # read three times
    need = (h.select(F.col("_lo").alias("_i")).unionByName(h.select(F.col("_hi").alias("_i"))).distinct()
            .select("_i", F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_v")))
    filled = running_totals(starts.unionByName(need), [], ["_i", "_kind"], ["_v"], ["_s"],
                            rows_per_task=rpt, how="max")
    s_at = written(filled.where(F.col("_kind") == 1).select("_i", "_s"))
    lo = s_at.select(F.col("_i").alias("_lo"), F.col("_s").alias("_slo"))
    hi = s_at.select(F.col("_i").alias("_hi"), F.col("_s").alias("_shi"))
    cal = (h.join(lo, "_lo").join(hi, "_hi")
           .select("_g", "_v", (F.col("_slo") + (F.col("_h") - F.floor("_h"))
                                * (F.col("_shi") - F.col("_slo"))).alias("_cal")))
    joined = df.join(cal, (df[g] == cal["_g"]) & (F.col(p).cast("double") == cal["_v"]), "left")
    return (joined.withColumn(out, F.when(F.col("_cal").isNull(), F.col(p).cast("double"))
                              .otherwise(F.col("_cal")))
            .drop("_g", "_v", "_cal"))


# ----------------------------------------------------------------------- A18
def mitigation_comparison(df: DataFrame, attrs: Sequence[str], y: str = "salary",
                          p: str = "predicted_salary",
                          threshold: float | None = None) -> DataFrame:
    """Before/after mean matching, per attribute: dp/eo and overall MAE/MSE.

    For every attribute the calibrated column is computed against that
    attribute's groups; the 'before' and 'after' disparity rows are unioned
    with a ``stage`` column. The median threshold is shared by both stages.
    """
    base = written(df.select(y, p, *attrs))  # every pass below scans these columns only
    if threshold is None:
        threshold = median_threshold(base, y)
    parts = []
    for a in attrs:
        cal = mean_match(base, p, a, out="_cal").where(F.col(a).isNotNull())
        errors = {stage: F.col(col) - F.col(y) for stage, col in (("before", p), ("after", "_cal"))}
        ov = cal.agg(*[F.avg(x).alias(f"{k}_{stage}") for stage, e in errors.items() for k, x in (("mae", F.abs(e)), ("mse", e * e))]).first()
        for stage, col in (("before", p), ("after", "_cal")):
            sub = cal.select(F.col(a), F.col(y), F.col(col).alias("_pred"))
            rates = group_rates(binarize(sub, threshold, y, "_pred"), [a], y, "_pred")
            d = disparities(rates).select("attribute", "dp_difference", "dp_ratio",
                                          "eo_difference", "eo_ratio")
            parts.append(d.withColumn("overall_mae", dlit(ov[f"mae_{stage}"]))
                         .withColumn("overall_mse", dlit(ov[f"mse_{stage}"])).withColumn("stage", F.lit(stage)))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


# ---------------------------------------------------------------- A14 / A15
def anova_by_group(df: DataFrame, attr: str, features: Sequence[str]) -> DataFrame:
    """One-way ANOVA F of each numeric feature across the groups of ``attr``.

    Per (feature, group): n, mean, sum of squared deviations (var_pop·n) in
    one grouped pass over the unpivoted features; then F from those moments.
    Requires ≥2 groups each with >1 value (as the reference). ``proxy_table``
    has p-values and flags.
    """
    long = df.select(F.col(attr).alias("group"),
                     F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                                  F.col(f).cast("double").alias("x"))
                                         for f in features])).alias("fx")) \
             .select("group", "fx.feature", "fx.x") \
             .where(F.col("x").isNotNull() & F.col("group").isNotNull())
    g = long.groupBy("feature", "group").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"),
        (F.var_pop("x") * F.count(F.lit(1))).alias("ss"))
    # grand mean per feature, joined back to the (small) per-group table
    grand = g.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"))
    res = (g.join(grand, "feature")
           .groupBy("feature")
           .agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("N"),
                F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm"))).alias("ssb"),
                F.sum("ss").alias("ssw"), F.min("n").alias("min_n")))
    f = safe_div(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("N") - F.col("k")))
    return (res.where((F.col("k") >= 2) & (F.col("min_n") > 1))
            .select(F.lit(attr).alias("protected"), "feature", "k", "N",
                    (F.col("k") - 1).alias("df_between"), (F.col("N") - F.col("k")).alias("df_within"),
                    f.alias("f_statistic")))


def pearson_proxies(df: DataFrame, attr: str, features: Sequence[str],
                    threshold: float = 0.3) -> DataFrame:
    """Pearson r (pairwise complete) of a numeric protected attribute with each feature; no row where either is constant."""
    a = F.col(attr).cast("double")

    def r(x):  # ``corr`` divides by zero for a constant
        spread = lambda one, other: F.sqrt(F.var_pop(F.when(other.isNotNull(), one)))
        return safe_div(F.covar_pop(a, x), spread(a, x) * spread(x, a))

    aggs = [r(F.col(f).cast("double")).alias(f) for f in features]
    wide = df.agg(*aggs)
    long = wide.unpivot([], list(features), "feature", "correlation")
    return (long.where(F.col("correlation").isNotNull() & ~F.isnan("correlation"))
            .select(F.lit(attr).alias("protected"), "feature", "correlation",
                    (F.abs("correlation") > dlit(threshold)).alias("is_proxy")))


def proxy_table(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], features: Sequence[str],
                threshold: float = PROXY_CORR_THRESHOLD, level: float = PROXY_P_THRESHOLD) -> DataFrame:
    """Each protected attribute against each numeric feature, in one scan.

    Categorical attributes: one-way ANOVA, its p-value, and a flag where
    p < ``level``; only with two or more groups that all have more than one
    value. Numeric attributes: Pearson's r over the rows that have both, and a
    flag where |r| > ``threshold``. One row per pair that has a statistic:
    ``protected``, ``feature``, ``method``, ``groups``, ``n``, ``statistic``,
    ``p_value`` (null for r), ``is_proxy``. Rows with a NULL attribute or
    feature take no part in that pair. A feature that is constant within all
    groups but differs between them has F = infinity and p = 0.

    A row becomes one per attribute (not one per pair); the moments of all
    features are aggregated side by side per (attribute, group), partially
    before the shuffle, so a hot group costs no more than another. Only the
    table of groups meets in a window, for the mean over all groups.
    """
    at = lambda a, group, value: F.struct(F.lit(a).alias("protected"), group.alias("group"), value.alias("value"))
    sides = [at(a, F.col(a).cast("string"), F.lit(None).cast("double")) for a in categorical]
    sides += [at(a, F.lit(None).cast("string"), F.col(a).cast("double")) for a in numeric]
    xs = [F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]
    long = df.select(F.explode(F.array(*sides)).alias("s"), *xs).select("s.*", *[f"_x{i}" for i in range(len(features))])
    long = long.where(F.col("group").isNotNull() | F.col("value").isNotNull())
    both = lambda x: F.when(F.col("value").isNotNull() & ~F.isnan("value"), x)
    moments = []
    for i, f in enumerate(features):
        x = F.when(~F.isnan(f"_x{i}"), F.col(f"_x{i}"))
        moments.append(F.struct(F.lit(f).alias("feature"), F.count(x).alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count(x)).alias("ss"),
                                F.covar_pop(F.when(~F.isnan("value"), F.col("value")), both(x)).alias("cov"), F.var_pop(both(x)).alias("vx"),
                                F.var_pop(F.when(x.isNotNull() & ~F.isnan("value"), F.col("value"))).alias("vy"), F.count(both(x)).alias("pairs")))
    groups = (long.groupBy("protected", "group").agg(F.array(*moments).alias("_m"))
              .select("protected", "group", F.explode("_m").alias("_m")).select("protected", "group", "_m.*"))
    # from here on a row per (attribute, group, feature); a numeric attribute has the one group NULL
    pair = W.partitionBy("protected", "feature")
    gap = F.col("m") - safe_div(F.sum(F.col("n") * F.col("m")).over(pair), F.sum("n").over(pair))
    table = (groups.withColumn("gap", gap).groupBy("protected", "feature")
             .agg(F.count("group").alias("groups"), F.sum("n").alias("n"), F.min("n").alias("least"),
                  F.sum(F.col("n") * F.col("gap") * F.col("gap")).alias("between"), F.sum("ss").alias("within"),
                  *[F.max(F.when(F.col("group").isNull(), F.col(c))).alias(c) for c in ("cov", "vx", "vy", "pairs")]))
    d1, d2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    infinite = (F.col("within") == 0) & (F.col("between") > 0)
    f = F.when(infinite, dlit(float("inf"))).otherwise(safe_div(safe_div(F.col("between"), d1), safe_div(F.col("within"), d2)))
    r = safe_div(F.col("cov"), F.sqrt("vx") * F.sqrt("vy"))  # NULL of a constant
    anova = F.col("groups") > 0
    enough = (F.col("groups") >= 2) & (F.col("least") > 1)
    return (table.withColumn("statistic", F.when(anova, F.when(enough, f)).otherwise(r))
            .where(F.col("statistic").isNotNull() & ~F.isnan("statistic"))
            .withColumn("p_value", F.when(anova, f_tail(F.col("statistic"), d1, d2)))
            .select("protected", "feature", F.when(anova, "anova").otherwise("pearson").alias("method"), F.when(anova, F.col("groups")).alias("groups"),
                    F.when(anova, F.col("n")).otherwise(F.col("pairs")).alias("n"), "statistic", "p_value",
                    F.when(anova, F.col("p_value") < dlit(level)).otherwise(F.abs("statistic") > dlit(threshold)).alias("is_proxy")))


def audit_verdict(disp: DataFrame, gap: float = AUDIT_GAP) -> DataFrame:
    """The audit's verdict per attribute: ``gaps_detected`` if the demographic-parity or the equalised-odds difference
    exceeds ``gap``, then with the fixed recommendations (else none). Missing differences count as 0."""
    dp, eo = (F.abs(F.coalesce(F.col(c), dlit(0.0))) for c in ("dp_difference", "eo_difference"))
    texts = F.array(*[F.lit(t) for t in AUDIT_RECOMMENDATIONS])
    return (disp.select("attribute", "dp_difference", "eo_difference", ((dp > dlit(gap)) | (eo > dlit(gap))).alias("gaps_detected"))
            .withColumn("recommendations", F.when(F.col("gaps_detected"), texts).otherwise(F.array().cast("array<string>"))))
