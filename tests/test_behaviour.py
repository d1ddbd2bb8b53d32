"""Behaviour cases the reference's own tests check (FIXTURES §2), on our operators."""
import datetime as dt
import os
import uuid

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from equiscope.operators import features as FE
from equiscope.operators import history as H
from equiscope.operators import metrics as M
from equiscope.session import ensure_checkpoint_dir
from equiscope.sources import io as IO
from equiscope.sources.tables import cand

SF001 = "/root/testdata/sf0.001"


def test_interval_arithmetic(spark):
    """150000 ± 20000 → 130000 / 170000 with confidence 1 - α."""
    df = spark.createDataFrame([(150000.0,)], "p double")
    r = FE.with_interval(df, "p", q_hat=20000.0, alpha=0.1).first()
    assert (r["min_salary"], r["max_salary"]) == (130000.0, 170000.0)
    assert r["confidence"] == pytest.approx(0.9)


def test_interval_order_on_every_scored_row(spark):
    """min ≤ predicted ≤ max for every row, with and without a conformal quantile."""
    c = cand(spark, SF001)
    for q in (None, 5000.0):
        iv = FE.with_interval(c, "predicted_salary", q_hat=q)
        bad = iv.where(~((F.col("min_salary") <= F.col("predicted_salary"))
                         & (F.col("predicted_salary") <= F.col("max_salary"))))
        assert bad.count() == 0


def test_history_contains_what_was_written(spark):
    """Append a prediction record, then the owner's first history page has it
    with the same amount."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"hist-{uuid.uuid4().hex}")
    schema = "id long, user_id long, created_at timestamp_ntz, predicted_salary double"
    old = [(i, 7, dt.datetime(2024, 1, 1 + i), 1000.0 * i) for i in range(1, 25)]
    IO.append_rows(spark.createDataFrame(old, schema), path)
    IO.append_rows(spark.createDataFrame([(99, 7, dt.datetime(2024, 2, 1), 123456.0)], schema), path)
    page = H.history_page(spark.read.parquet(path).where(F.col("user_id") == 7), page=1, size=20)
    rows = {r["id"]: r["predicted_salary"] for r in page.collect()}
    assert len(rows) == 20 and rows[99] == 123456.0


def test_unknown_attribute_is_an_error(spark):
    with pytest.raises(AnalysisException):
        M.group_metrics(cand(spark, SF001), "invalid_attr").collect()


def test_audit_cube_group_counts_sum_to_total(spark):
    """Identity: within each grouping level, group counts add up to the overall count."""
    from equiscope.operators.fairness import audit_cube
    from equiscope.plans.metrics_q import with_age_group
    cube = audit_cube(with_age_group(cand(spark, SF001)), ["gender", "age_group"])
    sums = {r["grouping_id"]: r["n"] for r in cube.groupBy("grouping_id").agg(F.sum("count").alias("n")).collect()}
    assert len(sums) == 4 and len(set(sums.values())) == 1


def test_conformal_calibration_coverage_at_least_nominal(spark):
    """Identity of split conformal with the "higher" rank: coverage on the
    calibration rows is at least 1 - α."""
    from equiscope.operators.conformal import conformal_summary
    from equiscope.plans.conformal_q import with_split
    for alpha in (0.1, 0.2):
        r = conformal_summary(with_split(cand(spark, SF001)), "split", "salary", "predicted_salary",
                              alpha).first()
        assert r["calibration_coverage"] >= 1 - alpha
