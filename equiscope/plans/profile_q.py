"""Registered queries: exploratory profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import cut, round_doubles
from ..functions.normal import normal_ppf_sql
from ..operators import profile as PR
from ..roles import CATEGORICAL_FEATURES, EDA_EXP_BIN_EDGES, EDA_EXP_BIN_LABELS, NUMERICAL_FEATURES
from ..sources.tables import cand, with_cand
from .registry import register

NUM = list(NUMERICAL_FEATURES) + ["age", "salary"]
CAT = list(CATEGORICAL_FEATURES) + ["gender"]
CAND_COLS = ["l_orderkey", "l_linenumber", "o_orderdate", "years_experience", "skills_count",
             "previous_salary", "interview_score", "education_level", "job_role", "location",
             "company_size", "gender", "age", "salary", "predicted_salary"]


@register("dataset_profile", with_cand(" UNION ALL ".join(f"""
SELECT {i} AS position, '{c}' AS "column", (SELECT count(*) FROM cand) AS rows, {len(CAND_COLS)} AS columns,
       count(*) FILTER (WHERE {c} IS NULL) AS null_count, count({c}) AS non_null_count FROM cand"""
    for i, c in enumerate(CAND_COLS))), ops=("S9", "E16"))
def dataset_profile(spark, sf):
    return PR.dataset_profile(cand(spark, sf).select(*CAND_COLS)).drop("dtype")


@register("missing_values", with_cand("""
SELECT 'previous_salary' AS "column", count(*) FILTER (WHERE previous_salary IS NULL) AS missing_count,
       round_even(count(*) FILTER (WHERE previous_salary IS NULL) * 100.0 / count(*), 2)::DOUBLE AS missing_pct
FROM cand HAVING count(*) FILTER (WHERE previous_salary IS NULL) > 0"""), ops=("E1",))
def missing_values(spark, sf):
    return PR.missing(cand(spark, sf).select(*CAND_COLS))


def _describe_sql():
    parts = []
    for c in NUM:
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS count, NULL::BIGINT AS "unique", NULL::VARCHAR AS top,
  NULL::BIGINT AS freq, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  round(min({c})::DOUBLE, 4) AS min, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25,
  round(quantile_cont({c}::DOUBLE, 0.5), 4) AS q50, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75,
  round(max({c})::DOUBLE, 4) AS max FROM cand""")
    for c in CAT:
        parts.append(f"""SELECT '{c}', CAST(sum(n) AS BIGINT), count(*), arg_min(v, [-n::DOUBLE, 0]), max(n),
  NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE
  FROM (SELECT {c} AS v, count(*) AS n FROM cand WHERE {c} IS NOT NULL GROUP BY 1)""")
    return " UNION ALL ".join(parts)


@register("describe_all", with_cand(_describe_sql()), ops=("E2",))
def describe_all(spark, sf):
    return round_doubles(PR.describe_all(cand(spark, sf), NUM, CAT))


@register("shape_stats", with_cand(" UNION ALL ".join(f"""
SELECT '{c}' AS "column", round(skewness({c}::DOUBLE), 4) AS skewness, round(kurtosis({c}::DOUBLE), 4) AS kurtosis
FROM cand""" for c in NUM)), ops=("E3",))
def shape_stats(spark, sf):
    return round_doubles(PR.shape_stats(cand(spark, sf), NUM))


@register("salary_histogram", with_cand("""
SELECT b.bin, round(r.lo + b.bin * (r.hi - r.lo) / 30.0, 4) AS left_edge,
       round(r.lo + (b.bin + 1) * (r.hi - r.lo) / 30.0, 4) AS right_edge, coalesce(c.cnt, 0) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(30)) b
CROSS JOIN (SELECT min(salary) AS lo, max(salary) AS hi FROM cand) r
LEFT JOIN (SELECT CAST(least(floor((salary - r2.lo) * (CAST(30 AS DOUBLE) / (r2.hi - r2.lo))), 29) AS INTEGER) AS bin,
                  count(*) AS cnt
           FROM cand, (SELECT min(salary) AS lo, max(salary) AS hi FROM cand) r2 GROUP BY 1) c
  ON c.bin = b.bin"""), ops=("E4",))
def salary_histogram(spark, sf):
    return round_doubles(PR.histogram(cand(spark, sf), "salary", 30))


@register("value_counts_role", with_cand("SELECT job_role, count(*) AS count FROM cand GROUP BY 1"),
          ops=("E5",))
def value_counts_role(spark, sf):
    return PR.value_counts(cand(spark, sf), "job_role")


@register("box_stats_role", with_cand("""
SELECT q.job_role, q.n, round(q.q1, 4) AS q1, round(q.median, 4) AS median, round(q.q3, 4) AS q3,
       round(q.q3 - q.q1, 4) AS iqr,
       round(min(c.salary) FILTER (WHERE c.salary BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1)), 4) AS whisker_low,
       round(max(c.salary) FILTER (WHERE c.salary BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1)), 4) AS whisker_high,
       count(*) FILTER (WHERE NOT c.salary BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1)) AS outliers,
       dense_rank() OVER (ORDER BY q.median DESC) AS median_rank
FROM (SELECT job_role, count(*) AS n, quantile_cont(salary, 0.25) AS q1, quantile_cont(salary, 0.5) AS median,
             quantile_cont(salary, 0.75) AS q3 FROM cand GROUP BY 1) q
JOIN cand c USING (job_role)
GROUP BY q.job_role, q.n, q.q1, q.median, q.q3"""), ops=("E6",))
def box_stats_role(spark, sf):
    out = PR.box_stats(cand(spark, sf), "job_role", "salary")
    return round_doubles(out.withColumn("median_rank", F.col("median_rank").cast("bigint")))


@register("salary_trend_line", with_cand("""
SELECT round(regr_slope(salary, years_experience), 4) AS slope,
       round(regr_intercept(salary, years_experience), 4) AS intercept,
       CAST(regr_count(salary, years_experience) AS BIGINT) AS n FROM cand"""), ops=("E7",))
def salary_trend_line(spark, sf):
    return round_doubles(PR.trend(cand(spark, sf), "years_experience", "salary"))


@register("correlation_matrix", with_cand(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE, {b}::DOUBLE), 4) AS corr FROM cand"
    for a in NUM for b in NUM)), ops=("E8",))
def correlation_matrix(spark, sf):
    return round_doubles(PR.correlations(cand(spark, sf), NUM))


EXP_BIN_SQL = """CASE WHEN years_experience > 0 AND years_experience <= 2 THEN '0-2'
     WHEN years_experience > 2 AND years_experience <= 5 THEN '2-5'
     WHEN years_experience > 5 AND years_experience <= 10 THEN '5-10'
     WHEN years_experience > 10 AND years_experience <= 15 THEN '10-15'
     WHEN years_experience > 15 AND years_experience <= 30 THEN '15+' END"""


PIVOT_COLS = ", ".join(f"round(median(salary) FILTER (WHERE exp_bin = '{b}'), 4) AS \"{b}\""
                       for b in EDA_EXP_BIN_LABELS)


@register("pivot_median_role_exp", with_cand(f"""
SELECT job_role, {PIVOT_COLS}
FROM (SELECT *, {EXP_BIN_SQL} AS exp_bin FROM cand) t GROUP BY job_role"""), ops=("E9", "P3"))
def pivot_median_role_exp(spark, sf):
    c = cand(spark, sf).withColumn("exp_bin", cut("years_experience", EDA_EXP_BIN_EDGES, EDA_EXP_BIN_LABELS))
    return round_doubles(PR.pivot_median(c, "job_role", "exp_bin", "salary", EDA_EXP_BIN_LABELS))


@register("group_means_education", with_cand("""
SELECT education_level, round_even(avg(salary), 0) AS mean_salary, count(*) AS count
FROM cand GROUP BY 1"""), ops=("E10",))
def group_means_education(spark, sf):
    return PR.group_means(cand(spark, sf), "education_level", "salary")


IQR_CTE = """qq AS (SELECT quantile_cont(salary, 0.25) AS q1, quantile_cont(salary, 0.75) AS q3 FROM cand)"""


@register("iqr_outliers", with_cand("""
SELECT round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr,
       round(q1 - 1.5 * (q3 - q1), 4) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 4) AS upper_bound,
       count(*) FILTER (WHERE salary < q1 - 1.5 * (q3 - q1) OR salary > q3 + 1.5 * (q3 - q1)) AS outliers,
       round_even(count(*) FILTER (WHERE salary < q1 - 1.5 * (q3 - q1) OR salary > q3 + 1.5 * (q3 - q1)) * 100.0
                  / count(*), 2)::DOUBLE AS outlier_pct,
       round(min(salary) FILTER (WHERE salary < q1 - 1.5 * (q3 - q1) OR salary > q3 + 1.5 * (q3 - q1)), 4) AS outlier_min,
       round(max(salary) FILTER (WHERE salary < q1 - 1.5 * (q3 - q1) OR salary > q3 + 1.5 * (q3 - q1)), 4) AS outlier_max
FROM cand, qq GROUP BY q1, q3""", IQR_CTE), ops=("E11",))
def iqr_outliers(spark, sf):
    summary, _ = PR.iqr_outliers(cand(spark, sf), "salary", "job_role")
    return round_doubles(summary)


@register("iqr_outliers_by_role", with_cand("""
SELECT job_role, count(*) AS outliers FROM cand, qq
WHERE salary < q1 - 1.5 * (q3 - q1) OR salary > q3 + 1.5 * (q3 - q1) GROUP BY job_role""", IQR_CTE),
          ops=("E11",))
def iqr_outliers_by_role(spark, sf):
    _, by = PR.iqr_outliers(cand(spark, sf), "salary", "job_role")
    return by


@register("qq_residuals", with_cand(f"""
SELECT CAST(rank AS BIGINT) AS rank, round(value, 4) AS value, round({normal_ppf_sql("m")}, 4) AS theoretical
FROM (SELECT rank, value,
             CASE WHEN rank = 0 THEN 1.0 - pow(0.5, 1.0 / CAST(n AS DOUBLE))
                  WHEN rank = n - 1 THEN pow(0.5, 1.0 / CAST(n AS DOUBLE))
                  ELSE (CAST(rank AS DOUBLE) + 1.0 - 0.3175) / (CAST(n AS DOUBLE) + 0.365) END AS m
      FROM (SELECT row_number() OVER (ORDER BY value) - 1 AS rank, value FROM res) r,
           (SELECT count(*) AS n FROM res) t) q""",
    """res AS (SELECT salary - predicted_salary AS value FROM cand
             WHERE salary - predicted_salary IS NOT NULL AND NOT isnan(salary - predicted_salary))"""),
          ops=("E12",))
def qq_residuals(spark, sf):
    c = cand(spark, sf).select((F.col("salary") - F.col("predicted_salary")).alias("residual"))
    return round_doubles(PR.qq_points(c, "residual"))
