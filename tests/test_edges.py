"""Results must not depend on size: NULL keys, infinities, wide spans, large degrees of freedom, file errors."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from equiscope.functions import stats
from equiscope.operators import drift, quantile
from equiscope.session import ensure_checkpoint_dir
from equiscope.sources import io as IO


def _path(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/edges-{os.urandom(4).hex()}-{name}"


def test_quantiles_alike_at_any_switch(spark):
    rnd = random.Random(3)
    rows = [(k, v) for k in ("a", None, "b") for v in [rnd.gauss(0, 1) for _ in range(60)] + [math.inf, -math.inf, -math.inf, 1.7e308, -1.7e308, 5e-324, 0.0]]
    rows += [("inf", math.inf)] * 30
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    small = {r["k"]: (r["n"], r["q"]) for r in quantile.grouped_quantiles(df, ["k"], "x", qs).collect()}
    large = {r["k"]: (r["n"], r["q"]) for r in quantile.grouped_quantiles(df, ["k"], "x", qs, bins=4, final_rows=5).collect()}
    assert small.keys() == {"a", None, "b", "inf"} and large == small
    values = sorted(v for _, v in rows)
    ranks = [0, 1, 3, 10, 100, len(values) - 1]
    for final_rows in (5, 50_000):
        got = quantile.order_statistics(df, "x", ranks, bins=4, final_rows=final_rows)
        assert got == {r: values[r] for r in ranks}
    assert quantile.quantile_linear(df, "x", 1.0) == math.inf


def test_tails_at_large_parameters():
    assert abs(stats.chi2_sf(1e8, 1e8) - 0.5) < 1e-4 and abs(stats.chi2_sf(1e9, 1e9) - 0.5) < 1e-4
    assert abs(stats.f_sf(2, 2, 1e11) - math.exp(-2)) < 1e-9
    below, above = stats.chi2_sf(1.99e5, 1.999e5), stats.chi2_sf(2.0011e5, 2.0101e5)  # either side of the switch of form
    assert 0 < below < 1 and abs(below - above) < 5e-3


def test_prediction_drift_of_few_rows(spark):
    a, b = (spark.createDataFrame([(float(i + s),) for i in range(5)], "p double") for s in (0, 3))
    row = drift.prediction_drift(a, b, "p").collect()
    assert len(row) == 1 and row[0]["mean_shift"] == 3.0 and row[0]["n_ref"] == 5


def test_candidates_by_header_name(spark):
    names = [f.name for f in IO.CANDIDATE_SCHEMA.fields][::-1]
    values = {"years_experience": "3.5", "education_level": "PhD", "skills_count": "NaN", "job_role": "Analyst", "previous_salary": "", "interview_score": "7",
              "location": "Leeds", "company_size": "50-200", "gender": "Female", "age": "30.0", "salary": "100000.0"}
    path = _path(spark, "csv")
    spark.createDataFrame([tuple(values[n] for n in names)], names).write.option("header", True).csv(path)
    row = IO.read_candidates(spark, path).first()
    assert (row["age"], row["salary"], row["gender"], row["skills_count"], row["previous_salary"]) == (30, 100000, "Female", None, None)
    with pytest.raises(ValueError, match="no column"):
        IO.read_candidates(spark, path, IO.T.StructType([IO.T.StructField("other", IO.T.StringType())]))


def test_unreadable_target_is_not_overwritten(spark):
    path = _path(spark, "table")
    spark.range(100).select(F.col("id").cast("string").alias("value")).write.text(path)
    with pytest.raises(Exception):
        IO.load_if_empty(spark, spark.range(1), path)
    assert spark.read.text(path).count() == 100
    with pytest.raises(Exception):
        IO.read_report(spark, path.replace("table", "table/.."), "no schema at all (")
