"""Registered queries: conformal intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd, round_doubles
from ..operators import conformal as CF
from ..operators import metrics as M
from ..sources.tables import cand, with_cand
from .registry import register

ALPHA = 0.1


def split_col():
    """Fixture split on the order key: every row lands in exactly one part."""
    k = F.pmod(F.col("l_orderkey"), F.lit(5))
    return (F.when(k == 0, F.lit("calibration")).when(k == 1, F.lit("test"))
            .otherwise(F.lit("train")))


def with_split(df):
    return df.withColumn("split", split_col())


SPLIT_CTES = ("""sp AS (
  SELECT *, CASE l_orderkey % 5 WHEN 0 THEN 'calibration' WHEN 1 THEN 'test' ELSE 'train' END AS split,
         abs(salary - predicted_salary) AS score
  FROM cand)""", """cal AS (SELECT score FROM sp WHERE split = 'calibration')""",
              """kk AS (SELECT count(*) AS n,
                least(CAST(ceil((count(*) + 1) * CAST(0.9 AS DOUBLE)) AS BIGINT), count(*) - 1) AS k0
         FROM cal)""",
              """q AS (SELECT score AS q_hat, kk.n FROM
        (SELECT score, row_number() OVER (ORDER BY score) - 1 AS r FROM cal) s, kk WHERE s.r = kk.k0)""")


@register("conformal_quantile", with_cand("""
SELECT round(q_hat, 4) AS q_hat, n AS calibration_size FROM q""", *SPLIT_CTES), ops=("A27",))
def conformal_quantile(spark, sf):
    c = with_split(cand(spark, sf))
    q, n = CF.conformal_quantile(c.where(F.col("split") == "calibration"), "salary",
                                 "predicted_salary", ALPHA)
    return spark.range(1).select(rnd(F.lit(q), 4).alias("q_hat"), F.lit(n).cast("bigint")
                                 .alias("calibration_size"))


@register("conformal_summary", with_cand("""
SELECT CAST(0.1 AS DOUBLE) AS alpha, CAST(0.9 AS DOUBLE) AS nominal_coverage, round(q.q_hat, 4) AS q_hat,
       count(*) FILTER (WHERE split = 'calibration') AS calibration_size,
       count(*) FILTER (WHERE split = 'test') AS test_size,
       round(avg(CASE WHEN salary BETWEEN predicted_salary - q.q_hat AND predicted_salary + q.q_hat
                 THEN 1.0 ELSE 0.0 END) FILTER (WHERE split = 'calibration'), 4) AS calibration_coverage,
       round(avg(CASE WHEN salary BETWEEN predicted_salary - q.q_hat AND predicted_salary + q.q_hat
                 THEN 1.0 ELSE 0.0 END) FILTER (WHERE split = 'test'), 4) AS test_coverage,
       round(avg(CASE WHEN salary BETWEEN predicted_salary - q.q_hat AND predicted_salary + q.q_hat
                 THEN 1.0 ELSE 0.0 END) FILTER (WHERE split = 'test') - 0.9, 4) AS test_coverage_gap,
       round(avg(2 * q.q_hat) FILTER (WHERE split = 'test'), 4) AS avg_interval_width
FROM sp, q WHERE split IN ('calibration', 'test') GROUP BY q.q_hat""", *SPLIT_CTES), ops=("A28", "A2", "P13"))
def conformal_summary(spark, sf):
    return round_doubles(CF.conformal_summary(with_split(cand(spark, sf)), "split", "salary",
                                              "predicted_salary", ALPHA))


@register("conformal_group_coverage", with_cand("""
SELECT gender, count(*) AS count,
       round(avg(CASE WHEN salary BETWEEN predicted_salary - q.q_hat AND predicted_salary + q.q_hat
                 THEN 1.0 ELSE 0.0 END), 4) AS coverage,
       round(avg(2 * q.q_hat), 4) AS mean_width
FROM sp, q WHERE split = 'test' GROUP BY gender""", *SPLIT_CTES), ops=("A29",))
def conformal_group_coverage(spark, sf):
    c = with_split(cand(spark, sf))
    q, _ = CF.conformal_quantile(c.where(F.col("split") == "calibration"), "salary",
                                 "predicted_salary", ALPHA)
    iv = CF.apply_intervals(c.where(F.col("split") == "test"), "predicted_salary", q)
    return round_doubles(M.group_interval_metrics(iv, "gender", "salary", "lower_bound", "upper_bound"))


@register("conformal_intervals", with_cand("""
SELECT l_orderkey, l_linenumber, round(salary, 4) AS actual_salary,
       round(predicted_salary, 4) AS predicted_salary,
       round(predicted_salary - q.q_hat, 4) AS lower_bound, round(predicted_salary + q.q_hat, 4) AS upper_bound,
       round(2 * q.q_hat, 4) AS interval_width,
       salary BETWEEN predicted_salary - q.q_hat AND predicted_salary + q.q_hat AS covered
FROM sp, q WHERE split = 'test'""", *SPLIT_CTES), ops=("A28", "P18"))
def conformal_intervals(spark, sf):
    c = with_split(cand(spark, sf))
    q, _ = CF.conformal_quantile(c.where(F.col("split") == "calibration"), "salary",
                                 "predicted_salary", ALPHA)
    iv = CF.apply_intervals(c.where(F.col("split") == "test"), "predicted_salary", q)
    iv = iv.withColumn("covered", F.col("salary").between(F.col("lower_bound"), F.col("upper_bound")))
    return round_doubles(iv.select("l_orderkey", "l_linenumber", F.col("salary").alias("actual_salary"),
                                   "predicted_salary", "lower_bound", "upper_bound", "interval_width",
                                   "covered"))
