"""Registered queries: fairness audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd, round_doubles
from ..operators import fairness as FA
from ..roles import AUDIT_RECOMMENDATIONS, NUMERICAL_FEATURES
from ..session import written
from ..sources.tables import cand, with_cand
from .metrics_q import AGE_GROUP_SQL, with_age_group
from .registry import register

ATTRS = ["gender", "age_group"]

SCORED_CTE = f"""scored AS (
  SELECT *, {AGE_GROUP_SQL} AS age_group,
         CAST(salary >= (SELECT median(salary) FROM cand) AS INTEGER) AS y_bin,
         CAST(predicted_salary >= (SELECT median(salary) FROM cand) AS INTEGER) AS p_bin
  FROM cand)"""

LONG_CTE = """long AS (
  SELECT 'gender' AS attribute, CAST(gender AS VARCHAR) AS "group", salary, predicted_salary, y_bin, p_bin FROM scored
  UNION ALL
  SELECT 'age_group', CAST(age_group AS VARCHAR), salary, predicted_salary, y_bin, p_bin FROM scored)"""

RATES_CTE = """rates AS (
  SELECT attribute, "group", count(*) AS count,
         avg(CAST(p_bin AS DOUBLE)) AS selection_rate,
         coalesce(CAST(sum(p_bin * y_bin) AS DOUBLE) / nullif(sum(y_bin), 0), 0.0) AS tpr,
         coalesce(CAST(sum(p_bin * (1 - y_bin)) AS DOUBLE) / nullif(sum(1 - y_bin), 0), 0.0) AS fpr,
         avg(predicted_salary) AS mean_predicted, avg(salary) AS mean_actual,
         avg(abs(predicted_salary - salary)) AS mae,
         avg((predicted_salary - salary) * (predicted_salary - salary)) AS mse,
         sqrt(avg((predicted_salary - salary) * (predicted_salary - salary))) AS rmse,
         avg(predicted_salary) - avg(salary) AS bias
  FROM long GROUP BY attribute, "group" HAVING "group" IS NOT NULL)"""

DISP_CTE = """disp AS (
  SELECT attribute, count(*) AS n_groups,
         max(selection_rate) - min(selection_rate) AS dp_difference,
         min(selection_rate) / nullif(max(selection_rate), 0) AS dp_ratio,
         greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) AS eo_difference,
         least(min(tpr) / nullif(max(tpr), 0), min(fpr) / nullif(max(fpr), 0)) AS eo_ratio,
         max(mean_predicted) - min(mean_predicted) AS mean_prediction_difference
  FROM rates GROUP BY attribute)"""


def _fair(spark, sf):
    return FA.fairness_metrics(with_age_group(cand(spark, sf)), ATTRS)


@register("fairness_group_rates", with_cand("""
SELECT attribute, "group", count,
       round(selection_rate, 4) AS selection_rate, round(tpr, 4) AS tpr, round(fpr, 4) AS fpr,
       round(mean_predicted, 4) AS mean_predicted, round(mean_actual, 4) AS mean_actual,
       round(mae, 4) AS mae, round(mse, 4) AS mse, round(rmse, 4) AS rmse, round(bias, 4) AS bias
FROM rates""", SCORED_CTE, LONG_CTE, RATES_CTE), ops=("A7", "A8", "A9", "A10"))
def fairness_group_rates(spark, sf):
    rates, _ = _fair(spark, sf)
    return round_doubles(rates)


@register("demographic_parity", with_cand("""
SELECT attribute, n_groups, round(dp_difference, 4) AS dp_difference, round(dp_ratio, 4) AS dp_ratio,
       round(eo_difference, 4) AS eo_difference, round(eo_ratio, 4) AS eo_ratio,
       round(mean_prediction_difference, 4) AS mean_prediction_difference,
       dp_ratio >= 0.8 AS four_fifths_pass
FROM disp""", SCORED_CTE, LONG_CTE, RATES_CTE, DISP_CTE), ops=("A7", "A8", "A9", "A11", "A12"))
def demographic_parity(spark, sf):
    _, disp = _fair(spark, sf)
    return round_doubles(disp)


@register("equalized_odds_gender", with_cand("""
SELECT attribute, round(eo_difference, 4) AS eo_difference, round(eo_ratio, 4) AS eo_ratio
FROM disp WHERE attribute = 'gender'""", SCORED_CTE, LONG_CTE, RATES_CTE, DISP_CTE), ops=("A9",))
def equalized_odds_gender(spark, sf):
    df = cand(spark, sf)
    rates = FA.group_rates(FA.binarize(df, FA.median_threshold(df)), ["gender"])
    return round_doubles(FA.disparities(rates).select("attribute", "eo_difference", "eo_ratio"))


STATUS_SQL = """
SELECT attribute,
       CASE WHEN abs(dp_difference) > 0.1 OR abs(mean_prediction_difference) > 50000 THEN 'WARNING'
            WHEN abs(dp_difference) > 0.05 OR abs(mean_prediction_difference) > 20000 THEN 'REVIEW'
            ELSE 'PASS' END AS status,
       round(dp_difference, 4) AS dp_difference,
       round(mean_prediction_difference, 4) AS mean_prediction_difference,
       list_filter([
         CASE WHEN NOT (abs(dp_difference) <= 0.05 AND abs(mean_prediction_difference) <= 20000)
              THEN 'Review ' || attribute || ' fairness: DP difference = ' || printf('%.3f', dp_difference) END,
         CASE WHEN abs(dp_difference) > 0.1 THEN 'Consider post-processing calibration for ' || attribute END],
         lambda x: x IS NOT NULL) AS recommendations
FROM disp"""


@register("fairness_status", with_cand(STATUS_SQL, SCORED_CTE, LONG_CTE, RATES_CTE, DISP_CTE),
          ops=("A13",))
def fairness_status(spark, sf):
    _, disp = _fair(spark, sf)
    st = FA.fairness_status(disp)
    return round_doubles(st.select("attribute", "status", "dp_difference",
                                   "mean_prediction_difference", "recommendations"))


@register("fairness_overall_status", with_cand("""
SELECT CASE WHEN count(*) = 0 THEN 'UNKNOWN'
            WHEN max(CASE WHEN status <> 'PASS' THEN 1 ELSE 0 END) = 1 THEN 'REVIEW'
            ELSE 'PASS' END AS overall_status,
       count(*) AS n_attributes
FROM st""", SCORED_CTE, LONG_CTE, RATES_CTE, DISP_CTE, f"st AS ({STATUS_SQL})"), ops=("A13",))
def fairness_overall_status(spark, sf):
    _, disp = _fair(spark, sf)
    return FA.overall_status(FA.fairness_status(disp)).select("overall_status", "n_attributes")


@register("audit_cube", with_cand(f"""
SELECT gender, age_group, CAST(GROUPING(gender, age_group) AS BIGINT) AS grouping_id,
       count(*) AS count,
       round(avg(predicted_salary), 4) AS mean_predicted, round(avg(salary), 4) AS mean_actual,
       round(avg(abs(predicted_salary - salary)), 4) AS mae,
       round(sqrt(avg((predicted_salary - salary) * (predicted_salary - salary))), 4) AS rmse,
       round(avg(predicted_salary) - avg(salary), 4) AS bias
FROM (SELECT *, {AGE_GROUP_SQL} AS age_group FROM cand) t
GROUP BY CUBE (gender, age_group)"""), ops=("A6",))
def audit_cube(spark, sf):
    return round_doubles(FA.audit_cube(with_age_group(cand(spark, sf)), ATTRS))


@register("mean_match_gender", with_cand("""
SELECT gender, count(*) AS count, round(avg(predicted_salary), 4) AS mean_before,
       round(avg(calibrated), 4) AS mean_after
FROM (SELECT c.gender, c.predicted_salary,
             c.predicted_salary + (SELECT avg(predicted_salary) FROM cand) - g.gmean AS calibrated
      FROM cand c JOIN (SELECT gender, avg(predicted_salary) AS gmean FROM cand GROUP BY gender) g
      ON c.gender = g.gender) t
GROUP BY gender"""), ops=("A16", "J5"))
def mean_match_gender(spark, sf):
    mm = FA.mean_match(written(cand(spark, sf).select("gender", "predicted_salary")),
                       "predicted_salary", "gender")
    return round_doubles(mm.groupBy("gender").agg(
        F.count(F.lit(1)).alias("count"), F.avg("predicted_salary").alias("mean_before"),
        F.avg("calibrated").alias("mean_after")))


MITIG_SQL_PARTS = []
for _a in ATTRS:
    for _stage, _col in (("before", "predicted_salary"), ("after", "cal")):
        MITIG_SQL_PARTS.append(f"""
SELECT '{_a}' AS attribute, '{_stage}' AS stage,
       round(max(sr) - min(sr), 4) AS dp_difference,
       round(min(sr) / nullif(max(sr), 0), 4) AS dp_ratio,
       round(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 4) AS eo_difference,
       round(least(min(tpr) / nullif(max(tpr), 0), min(fpr) / nullif(max(fpr), 0)), 4) AS eo_ratio,
       round((SELECT avg(abs({_col} - salary)) FROM m_{_a}), 4) AS overall_mae,
       round((SELECT avg(({_col} - salary) * ({_col} - salary)) FROM m_{_a}), 4) AS overall_mse
FROM (SELECT g, avg(CAST(pb AS DOUBLE)) AS sr,
             coalesce(CAST(sum(pb * yb) AS DOUBLE) / nullif(sum(yb), 0), 0.0) AS tpr,
             coalesce(CAST(sum(pb * (1 - yb)) AS DOUBLE) / nullif(sum(1 - yb), 0), 0.0) AS fpr
      FROM (SELECT {_a} AS g, CAST(salary >= (SELECT median(salary) FROM cand) AS INTEGER) AS yb,
                   CAST({_col} >= (SELECT median(salary) FROM cand) AS INTEGER) AS pb FROM m_{_a}) x
      GROUP BY g) r""")

MITIG_CTES = [f"""m_{a} AS (
  SELECT s.*, s.predicted_salary + (SELECT avg(predicted_salary) FROM scored) - gm.gmean AS cal
  FROM scored s JOIN (SELECT {a} AS k, avg(predicted_salary) AS gmean FROM scored
                      WHERE {a} IS NOT NULL GROUP BY {a}) gm ON s.{a} = gm.k)""" for a in ATTRS]


@register("mitigation_comparison", with_cand(
    "\nUNION ALL\n".join(MITIG_SQL_PARTS), SCORED_CTE, *MITIG_CTES), ops=("A16", "A18"))
def mitigation_comparison(spark, sf):
    df = with_age_group(cand(spark, sf))
    return round_doubles(FA.mitigation_comparison(df, ATTRS))


@register("anova_proxy_gender", with_cand(" UNION ALL ".join(f"""
SELECT 'gender' AS protected, '{f}' AS feature, count(*) AS k, sum(n) AS "N",
       count(*) - 1 AS df_between, sum(n) - count(*) AS df_within,
       round((sum(n * (m - gm) * (m - gm)) / (count(*) - 1))
             / nullif(sum(ss) / (sum(n) - count(*)), 0), 4) AS f_statistic
FROM (SELECT gender, count(*) AS n, avg(CAST({f} AS DOUBLE)) AS m,
             var_pop(CAST({f} AS DOUBLE)) * count(*) AS ss
      FROM cand WHERE {f} IS NOT NULL AND gender IS NOT NULL GROUP BY gender) g,
     (SELECT avg(CAST({f} AS DOUBLE)) AS gm FROM cand WHERE {f} IS NOT NULL AND gender IS NOT NULL) o
""" for f in NUMERICAL_FEATURES).replace('sum(n) AS "N"', 'CAST(sum(n) AS BIGINT) AS "N"')
   .replace("sum(n) - count(*) AS df_within", "CAST(sum(n) - count(*) AS BIGINT) AS df_within")),
    ops=("A14",))
def anova_proxy_gender(spark, sf):
    return round_doubles(FA.anova_by_group(cand(spark, sf), "gender", list(NUMERICAL_FEATURES)))


@register("pearson_proxy_age", with_cand(" UNION ALL ".join(f"""
SELECT 'age' AS protected, '{f}' AS feature,
       round(corr(CAST(age AS DOUBLE), CAST({f} AS DOUBLE)), 4) AS correlation,
       abs(corr(CAST(age AS DOUBLE), CAST({f} AS DOUBLE))) > 0.3 AS is_proxy
FROM cand""" for f in NUMERICAL_FEATURES)), ops=("A15",))
def pearson_proxy_age(spark, sf):
    return round_doubles(FA.pearson_proxies(cand(spark, sf), "age", list(NUMERICAL_FEATURES)))


@register("quantile_match_gender", with_cand("""
SELECT c.gender, count(*) AS count, round(avg(c.predicted_salary), 4) AS mean_before,
       round(avg(coalesce(q.cal, c.predicted_salary)), 4) AS mean_after,
       round(min(coalesce(q.cal, c.predicted_salary)), 4) AS min_after,
       round(max(coalesce(q.cal, c.predicted_salary)), 4) AS max_after
FROM cand c LEFT JOIN cal q ON q.g = c.gender AND q.v = c.predicted_salary
GROUP BY c.gender""", """vals AS (SELECT gender AS g, CAST(predicted_salary AS DOUBLE) AS v FROM cand
         WHERE predicted_salary IS NOT NULL AND NOT isnan(predicted_salary))""",
    """srt AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM vals)""",
    """tot AS (SELECT count(*) AS n FROM vals)""",
    """rk AS (SELECT g, v, CAST(rank() OVER (PARTITION BY g ORDER BY v) - 1 AS DOUBLE) AS below,
              count(*) OVER (PARTITION BY g) AS ng FROM vals WHERE g IS NOT NULL)""",
    """hh AS (SELECT DISTINCT g, v, coalesce(below / CAST(nullif(ng - 1, 0) AS DOUBLE), 0.0)
                                * CAST(n - 1 AS DOUBLE) AS h FROM rk, tot)""",
    """cal AS (SELECT hh.g, hh.v, lo.v + (hh.h - floor(hh.h)) * (hi.v - lo.v) AS cal
        FROM hh JOIN srt lo ON lo.i = CAST(floor(hh.h) AS BIGINT) JOIN srt hi ON hi.i = CAST(ceil(hh.h) AS BIGINT))"""),
    ops=("A17",))
def quantile_match_gender(spark, sf):
    qm = FA.quantile_match(written(cand(spark, sf).select("gender", "predicted_salary")),
                           "predicted_salary", "gender")
    return round_doubles(qm.groupBy("gender").agg(
        F.count(F.lit(1)).alias("count"), F.avg("predicted_salary").alias("mean_before"),
        F.avg("calibrated").alias("mean_after"), F.min("calibrated").alias("min_after"),
        F.max("calibrated").alias("max_after")))


@register("fairness_export", with_cand("""
SELECT 'group' AS section, attribute, "group", NULL::VARCHAR AS status, count,
       round(mean_predicted, 2) AS mean_predicted, round(mae, 2) AS mae, round(bias, 2) AS bias,
       NULL::DOUBLE AS dp_difference
FROM rates
UNION ALL
SELECT 'attribute', attribute, NULL, status, NULL, NULL, NULL, NULL, round(dp_difference, 2)
FROM (""" + STATUS_SQL + """) s""", SCORED_CTE, LONG_CTE, RATES_CTE, DISP_CTE), ops=("S11",))
def fairness_export(spark, sf):
    rates, disp = _fair(spark, sf)
    st = FA.fairness_status(disp)
    g = rates.select(F.lit("group").alias("section"), "attribute", "group",
                     F.lit(None).cast("string").alias("status"), "count",
                     rnd("mean_predicted", 2).alias("mean_predicted"),
                     rnd("mae", 2).alias("mae"), rnd("bias", 2).alias("bias"),
                     F.lit(None).cast("double").alias("dp_difference"))
    a = st.select(F.lit("attribute").alias("section"), "attribute",
                  F.lit(None).cast("string").alias("group"), "status",
                  F.lit(None).cast("bigint").alias("count"),
                  F.lit(None).cast("double").alias("mean_predicted"),
                  F.lit(None).cast("double").alias("mae"),
                  F.lit(None).cast("double").alias("bias"),
                  rnd("dp_difference", 2).alias("dp_difference"))
    return g.unionByName(a)


# Attributes of the proxy table: with k groups the between-degrees of freedom
# are k - 1; all three have an odd k, so that the oracle has the F tail as the
# finite sum of the incomplete beta function with an integer parameter.
PROXY_CATEGORICAL = ("gender", "location", "company_size")


def _anova_sql(attr: str, feature: str) -> str:
    return f"""
SELECT '{attr}' AS protected, '{feature}' AS feature, count(*) AS groups, CAST(sum(n) AS BIGINT) AS n,
       (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / nullif(sum(ss) / (sum(n) - count(*)), 0) AS f
FROM (SELECT {attr}, count(*) AS n, avg(CAST({feature} AS DOUBLE)) AS m, var_pop(CAST({feature} AS DOUBLE)) * count(*) AS ss
      FROM cand WHERE {feature} IS NOT NULL AND {attr} IS NOT NULL GROUP BY {attr}) g,
     (SELECT avg(CAST({feature} AS DOUBLE)) AS gm FROM cand WHERE {feature} IS NOT NULL AND {attr} IS NOT NULL) o"""


@register("proxy_features", with_cand("""
SELECT protected, feature, 'anova' AS method, groups, n, round(f, 4) AS statistic, round(p, 4) AS p_value, p < 0.05 AS is_proxy FROM tail
UNION ALL """ + " UNION ALL ".join(f"""
SELECT '{a}', '{f}', 'pearson', NULL, CAST(regr_count(CAST({a} AS DOUBLE), CAST({f} AS DOUBLE)) AS BIGINT),
       round(corr(CAST({a} AS DOUBLE), CAST({f} AS DOUBLE)), 4), NULL, abs(corr(CAST({a} AS DOUBLE), CAST({f} AS DOUBLE))) > 0.3
FROM cand""" for a in ("age", "salary") for f in NUMERICAL_FEATURES),
    "anova AS (" + " UNION ALL ".join(_anova_sql(a, f) for a in PROXY_CATEGORICAL for f in NUMERICAL_FEATURES) + ")",
    # I_x(a, b) for integer b: x^a times the first b terms of (1 - x)^-a in powers of 1 - x
    """parts AS (SELECT *, (n - groups) / 2.0 AS a, CAST((groups - 1) / 2 AS BIGINT) AS b,
                     (groups - 1) * f / ((n - groups) + (groups - 1) * f) AS q FROM anova),
tail AS (SELECT *, exp(a * ln(1 - q)) * (SELECT sum(exp(lgamma(a + j) - lgamma(a) - lgamma(j + 1) + CASE WHEN j = 0 THEN 0 ELSE j * ln(q) END))
                                         FROM range(0, 100) t(j) WHERE j < b) AS p FROM parts)"""), ops=("A14", "A15"))
def proxy_features(spark, sf):
    """Gender, location and company size by ANOVA, age and (as an attribute that previous pay betrays) salary by Pearson."""
    return round_doubles(FA.proxy_table(cand(spark, sf), PROXY_CATEGORICAL, ("age", "salary"), list(NUMERICAL_FEATURES)))


# Attributes of which some have gaps: pay bands split the predictions, bands of the interview score their errors.
VERDICT_ATTRS = {
    "gender": "CAST(gender AS STRING)",
    "pay_band": "CASE WHEN previous_salary >= 30000 THEN 'upper' WHEN previous_salary < 30000 THEN 'lower' END",
    "score_band": "CASE WHEN interview_score >= 7 THEN 'upper' WHEN interview_score < 7 THEN 'lower' END",
    "line_band": "CASE WHEN skills_count <= 2 OR (skills_count = 3 AND previous_salary >= 20000) THEN 'early' WHEN skills_count >= 3 THEN 'late' END",
}
VERDICT_LONG = "long AS (" + " UNION ALL ".join(
    f"""SELECT '{a}' AS attribute, {e.replace("STRING", "VARCHAR")} AS "group", salary, predicted_salary, y_bin, p_bin FROM scored""" for a, e in VERDICT_ATTRS.items()) + ")"


def _verdict_disparities(spark, sf):
    df = cand(spark, sf)
    df = df.select("salary", "predicted_salary", *[F.expr(e).alias(a) for a, e in VERDICT_ATTRS.items()])
    return FA.fairness_metrics(df, list(VERDICT_ATTRS))[1]


@register("fairness_verdicts", with_cand(f"""
SELECT s.attribute, s.status, s.dp_difference, s.mean_prediction_difference, s.recommendations,
       round(d.eo_difference, 4) AS eo_difference, (abs(d.dp_difference) > 0.05 OR abs(d.eo_difference) > 0.05) AS gaps_detected,
       CASE WHEN abs(d.dp_difference) > 0.05 OR abs(d.eo_difference) > 0.05 THEN [{", ".join(f"'{t}'" for t in AUDIT_RECOMMENDATIONS)}] ELSE [] END AS audit_recommendations
FROM ({STATUS_SQL}) s JOIN disp d USING (attribute)""", SCORED_CTE, VERDICT_LONG, RATES_CTE, DISP_CTE), ops=("A13", "S11"))
def fairness_verdicts(spark, sf):
    """Dashboard status and audit verdict of attributes with and without gaps."""
    disp = _verdict_disparities(spark, sf)
    audit = FA.audit_verdict(disp).select("attribute", "gaps_detected", F.col("recommendations").alias("audit_recommendations"))
    status = FA.fairness_status(disp).select("attribute", "status", "dp_difference", "mean_prediction_difference", "recommendations", "eo_difference")
    return round_doubles(status.join(audit, "attribute"))


_Q = "chr(34)"
_NA = "CASE WHEN {0} <> 0 THEN {1} ELSE 'N/A' END"
_WHOLE = "CAST(CAST(floor({0} + 0.5) AS BIGINT) AS VARCHAR)"


@register("fairness_report", with_cand(f"""
SELECT section, CAST(position AS INTEGER) AS position, CASE WHEN section = '4 recommendations' THEN position || ',' || line ELSE line END AS line
FROM (SELECT section, line, row_number() OVER (PARTITION BY section ORDER BY a, b, c) AS position FROM (
  SELECT '1 status' AS section, '' AS a, '' AS b, 0 AS c, 'Overall Status,' || CASE WHEN max(CASE WHEN status <> 'PASS' THEN 1 ELSE 0 END) = 1 THEN 'REVIEW' ELSE 'PASS' END AS line FROM st
  UNION ALL
  SELECT '2 attributes', st.attribute, '', 0, st.attribute || ',' || status || ',' || printf('%.4f', d.dp_difference) || ',' || printf('%.2f', d.mean_prediction_difference) || ','
         || {_Q} || CASE WHEN len(recommendations) = 0 THEN 'None' ELSE array_to_string(recommendations, '; ') END || {_Q} FROM st JOIN disp d USING (attribute)
  UNION ALL
  SELECT '3 groups', attribute, "group", 0, attribute || ',' || {_Q} || "group" || {_Q} || ',' || count || ',' || {_WHOLE.format("mean_predicted")} || ','
         || {_NA.format("mean_actual", _WHOLE.format("mean_actual"))} || ',' || {_NA.format("mae", "printf('%.2f', mae)")} || ',' || {_NA.format("rmse", "printf('%.2f', rmse)")}
         || ',' || {_WHOLE.format("bias")} FROM rates
  UNION ALL
  SELECT '4 recommendations', attribute, '', i, {_Q} || recommendations[i] || {_Q} FROM (SELECT attribute, recommendations, unnest(range(1, len(recommendations) + 1)) AS i FROM st WHERE status <> 'PASS')))""",
    SCORED_CTE, VERDICT_LONG, RATES_CTE, DISP_CTE, f"st AS ({STATUS_SQL})"), ops=("S11", "A13"))
def fairness_report(spark, sf):
    """The whole export: overall status, attributes, groups and numbered recommendations."""
    df = cand(spark, sf).select("salary", "predicted_salary", *[F.expr(e).alias(a) for a, e in VERDICT_ATTRS.items()])
    rates, disp = FA.fairness_metrics(df, list(VERDICT_ATTRS))
    return FA.report_lines(FA.fairness_status(disp), rates)
