"""Registered queries: model-quality metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import cut, round_doubles
from ..operators import metrics as M
from ..roles import AGE_GROUP_EDGES, AGE_GROUP_LABELS
from ..sources.tables import cand, with_cand
from .registry import register

AGE_GROUP_SQL = """CASE WHEN age > 20 AND age <= 30 THEN '20-30'
            WHEN age > 30 AND age <= 40 THEN '30-40'
            WHEN age > 40 AND age <= 50 THEN '40-50'
            WHEN age > 50 AND age <= 65 THEN '50+' END"""

R2_SQL = """CASE WHEN count(salary) < 2 THEN NULL
            WHEN var_pop(salary) * count(salary) = 0 THEN
                 CASE WHEN sum((salary - predicted_salary) * (salary - predicted_salary)) = 0 THEN 1.0 ELSE 0.0 END
            ELSE 1.0 - sum((salary - predicted_salary) * (salary - predicted_salary))
                       / (var_pop(salary) * count(salary)) END"""

GROUP_METRICS_SQL = """count(*) AS count,
       round(avg(predicted_salary), 4) AS mean_predicted,
       round(avg(salary), 4) AS mean_actual,
       round(avg(abs(predicted_salary - salary)), 4) AS mae,
       round(avg((predicted_salary - salary) * (predicted_salary - salary)), 4) AS mse,
       round(sqrt(avg((predicted_salary - salary) * (predicted_salary - salary))), 4) AS rmse,
       round(avg(predicted_salary) - avg(salary), 4) AS bias"""


def with_age_group(df):
    return df.withColumn("age_group", cut("age", AGE_GROUP_EDGES, AGE_GROUP_LABELS))


@register("group_metrics_gender", with_cand(f"""
SELECT gender, {GROUP_METRICS_SQL}
FROM cand GROUP BY gender"""), ops=("A4", "A10"))
def group_metrics_gender(spark, sf):
    return round_doubles(M.group_metrics(cand(spark, sf), "gender"))


@register("group_metrics_role_r2", with_cand(f"""
SELECT job_role, {GROUP_METRICS_SQL}, round({R2_SQL}, 4) AS r2
FROM cand GROUP BY job_role"""), ops=("A3",))
def group_metrics_role_r2(spark, sf):
    return round_doubles(M.group_metrics(cand(spark, sf), "job_role", r2=True))


@register("intersectional_metrics", with_cand(f"""
SELECT gender, {AGE_GROUP_SQL} AS age_group, {GROUP_METRICS_SQL}
FROM cand GROUP BY 1, 2"""), ops=("A5",))
def intersectional_metrics(spark, sf):
    return round_doubles(M.group_metrics(with_age_group(cand(spark, sf)), ["gender", "age_group"]))


@register("regression_metrics", with_cand(f"""
SELECT count(*) AS n,
       round(avg(abs(predicted_salary - salary)), 4) AS mae,
       round(avg((predicted_salary - salary) * (predicted_salary - salary)), 4) AS mse,
       round(sqrt(avg((predicted_salary - salary) * (predicted_salary - salary))), 4) AS rmse,
       round({R2_SQL}, 4) AS r2,
       round(avg(abs((salary - predicted_salary) / nullif(salary, 0))) * 100.0, 4) AS mape
FROM cand"""), ops=("A1",))
def regression_metrics(spark, sf):
    return round_doubles(M.regression_metrics(cand(spark, sf)))


@register("interval_metrics_fixed", with_cand("""
SELECT count(*) AS n,
       round(avg(CASE WHEN salary BETWEEN predicted_salary - 5000.0 AND predicted_salary + 5000.0
                 THEN 1.0 ELSE 0.0 END), 4) AS coverage,
       round(avg(CAST(10000.0 AS DOUBLE)), 4) AS mean_width,
       round(CAST(0.9 AS DOUBLE), 4) AS nominal,
       round(avg(CASE WHEN salary BETWEEN predicted_salary - 5000.0 AND predicted_salary + 5000.0
                 THEN 1.0 ELSE 0.0 END) - 0.9, 4) AS coverage_gap
FROM cand"""), ops=("A2",))
def interval_metrics_fixed(spark, sf):
    df = cand(spark, sf).select(
        "salary", (F.col("predicted_salary") - 5000.0).alias("lo"),
        (F.col("predicted_salary") + 5000.0).alias("hi"))
    return round_doubles(M.interval_metrics(df, "salary", "lo", "hi", alpha=0.1))


@register("candidates_csv_roundtrip", with_cand(f"""
SELECT gender, {GROUP_METRICS_SQL}
FROM cand GROUP BY gender"""), ops=("S1", "S2", "S3", "S5"))
def candidates_csv_roundtrip(spark, sf):
    """Candidate rows written as header CSV and Parquet in the shared scratch
    folder, read back with an explicit schema, then audited (must equal the
    direct query)."""
    import os
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources import io as IO
    root = os.path.join(ensure_checkpoint_dir(spark), f"io-{uuid.uuid4().hex}")
    cols = ["gender", "salary", "predicted_salary"]
    c = cand(spark, sf).select(*cols)
    IO.write_csv(c, f"{root}/csv")
    schema = "gender string, salary double, predicted_salary double"
    back = IO.read_candidates(spark, f"{root}/csv", schema=__import__("pyspark.sql.types", fromlist=["_parse_datatype_string"])._parse_datatype_string(schema))
    IO.write_processed(back, f"{root}/parquet")
    return round_doubles(M.group_metrics(IO.read_processed(spark, f"{root}/parquet"), "gender"))
