"""Passes shared between columns and training sets: exact, over the input once, without a join that gathers a group."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from equiscope.operators import drift as DR
from equiscope.operators import fairness as FA
from equiscope.operators import model as MD
from equiscope.operators import profile as PR
from equiscope.operators import quantile as Q
from equiscope.roles import FeatureRoles

ROLES = FeatureRoles(("x", "z"), ("c",), ("g",), "y")


def frame(spark, n=240):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        x, z = float(rng.normal(3)), float(rng.integers(0, 6))
        rows.append((i, None if i % 7 == 0 else x, z, None if i % 11 == 0 else "abc"[i % 3] if i < n - 1 else "rare", "FM"[i % 2], 2 * x + z + i % 3, 2 * x + z, i % 4))
    return spark.createDataFrame(rows, "id long, x double, z double, c string, g string, y double, p double, fold int")


def watched(df):
    """(df, rows read of it so far)"""
    read = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    return df.mapInPandas(run, df.schema), read


@pytest.mark.parametrize("bins, final_rows", [(1024, 4096), (3, 5), (3, 0)])
def test_column_quantiles_of_all_training_sets(spark, bins, final_rows):
    rng = np.random.default_rng(3)
    a = [None if i % 9 == 0 else math.nan if i % 31 == 0 else math.inf if i % 17 == 0 else -math.inf if i % 23 == 0 else float(rng.normal()) for i in range(400)]
    b = [float(rng.integers(0, 4)) for _ in a]
    gone = [1.0 if i % 5 == 2 else None for i in range(len(a))]
    df = spark.createDataFrame([(x, y, w, None, i % 5) for i, (x, y, w) in enumerate(zip(a, b, gone))], "a double, b double, gone double, none double, f int")
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = Q.column_quantiles(df, ["a", "b", "gone", "none"], qs, "f", bins, final_rows)
    assert set(got) == {(c, s) for c in ("a", "b", "gone", "none") for s in (None, 0, 1, 2, 3, 4)}
    for s in (None, 0, 3):
        train = df if s is None else df.where(F.col("f") != s)
        for c in ("a", "b", "gone", "none"):
            assert got[c, s] == Q.quantiles_linear(train, c, qs)
    assert got["gone", 2] == got["none", None] == [None] * 5


def test_statistics_of_training_sets_are_those_of_separate_fits(spark):
    df = frame(spark)
    shared = MD._training_stats(df, ROLES, "fold")
    assert set(shared) == {None, 0, 1, 2, 3}
    for s, (st, levels) in shared.items():
        train = df if s is None else df.where(F.col("fold") != s)
        filled = train.select(*[F.coalesce(c, F.lit(Q.median(train, c))).alias(c) for c in ROLES.numerical])
        for c in ROLES.numerical:
            assert st.medians[c] == Q.median(train, c)
            mean, std = filled.agg(F.avg(c), F.stddev_pop(c)).first()
            assert st.means[c] == pytest.approx(mean, rel=1e-12) and st.stds[c] == pytest.approx(std, rel=1e-12)
        assert st.modes == MD.most_frequent(train, ROLES.categorical)
        assert sorted(levels["c"]) == sorted(r[0] for r in train.select("c").distinct().collect() if r[0])
        assert MD.feature_names(MD._frozen(df, st, levels, ROLES), ROLES) == ["x", "z", *[f"c_{v}" for v in sorted(levels["c"])]]


def test_the_input_is_computed_once(spark):
    df = frame(spark)
    n = df.count()
    rows, read = watched(df)
    gbt = MD.estimators("y")["gradient_boosting"].setMaxIter(1).setMaxDepth(2)
    oof, _ = MD.cross_fit(rows, ROLES, "y", "fold", {"ridge": 1.0, "boost": gbt})
    assert oof.count() == n and read.value == n
    for run, times in ((lambda d: MD.preprocessor(d, ROLES), 1), (lambda d: MD.fit_preprocessor_stats(d, ROLES), 1),
                       (lambda d: FA.mitigation_comparison(d, ["g"], "y", "p").collect(), 1), (lambda d: PR.qq_points(d, "p").collect(), 1),
                       (lambda d: FA.quantile_match(d, "p", "g").collect(), 2), (lambda d: FA.mean_match(d, "p", "g").collect(), 2)):
        rows, read = watched(df)
        run(rows)
        assert read.value == times * n


def test_psi_of_rows_lists_no_distinct_values(spark):
    df = frame(spark).select((F.col("id") % 2).alias("side"), "x", "z")
    long = DR.long_numeric_sided(df, "side", ["x", "z"])
    for edges in ("shared", "own"):
        rows = DR.psi_numeric(long, edges=edges)
        counts = DR.psi_numeric(DR.value_counts_by_side(long), edges=edges)
        assert {r[0]: pytest.approx(r[1]) for r in counts.collect()} == {r[0]: r[1] for r in rows.collect()}
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert not any("Aggregate" in line and "x#" in line.split("], [")[0] for line in plan.splitlines())


def test_rows_of_large_groups_meet_broadcast_windows(spark, monkeypatch):
    df = spark.createDataFrame([("k" if i % 3 else "j", float(i * 37 % 101)) for i in range(600)], "k string, x double")
    hinted, join = [], Q._null_safe

    def watch(left, right, keys, how="inner"):
        if "x" in left.columns:  # rows, not states
            hinted.append("ResolvedHint" in right._jdf.queryExecution().analyzed().toString())
        return join(left, right, keys, how)

    monkeypatch.setattr(Q, "_null_safe", watch)
    got = {r["k"]: r["q"] for r in Q.grouped_quantiles(df, ["k"], "x", [0.25, 0.5], bins=4, final_rows=5).collect()}
    assert got == {r["k"]: r["q"] for r in df.groupBy("k").agg(F.percentile("x", [0.25, 0.5]).alias("q")).collect()}
    assert hinted and all(hinted)
