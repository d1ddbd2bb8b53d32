"""Boosted trees from shared histogram passes: those of Spark ML's estimator, few jobs, odd rows."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from equiscope.operators import model as MD
from equiscope.operators import trees as T
from equiscope.roles import FeatureRoles

ROLES = FeatureRoles(("x", "z", "same"), ("c", "d"), (), "y")


def frame(spark, n=600, folds=3):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        x, z = float(rng.normal(3)), float(rng.integers(0, 6))
        c = None if i % 11 == 0 else "abcd"[i % 4] if i % folds else "only in fold 0" if i % 7 == 0 else "a"
        rows.append((i, None if i % 7 == 0 else x, z, 2.0, c, "uv"[i % 2], x * x + 3 * z + (5 if c == "b" else 0) + float(rng.normal()) / 5, i % folds))
    return spark.createDataFrame(rows, "id long, x double, z double, same double, c string, d string, y double, fold int").repartition(3, "id")


def boosted(rounds=4, **more):
    e = MD.estimators("y")["gradient_boosting"].setMaxIter(rounds)
    for name, value in more.items():
        e.set(e.getParam(name), value)
    return e


@pytest.mark.parametrize("local_rows, settings", [(10_000, {}), (0, {"rounds": 2, "maxDepth": 8, "minInstancesPerNode": 3, "maxBins": 16})])
def test_trees_are_those_of_the_estimator(spark, monkeypatch, local_rows, settings):
    monkeypatch.setattr(T, "LOCAL_ROWS", local_rows)
    df = frame(spark).cache()
    spec, kind = MD.boost_of(boosted(**settings))
    models = T.fit_boosts(df, ROLES, "y", "fold", [spec], MD._training_stats(df, ROLES, "fold"), **dict(kind))
    oof, fitted = MD.cross_fit(df, ROLES, "y", "fold", {"boost": boosted(**settings)})
    got = {r["id"]: r["p_boost"] for r in oof.collect()}
    assert len(got) == 600 and isinstance(fitted["boost"], T.BoostFit)
    for f in (0, None):
        train = df if f is None else df.where(F.col("fold") != f)  # other rows may meet splits that are equal on these ones
        was = Pipeline(stages=[MD.preprocessor(train, ROLES), boosted(**settings)]).fit(train).transform(train)
        both = models[f, spec].transform(was.withColumnRenamed("prediction", "was")).select("prediction", "was").collect()
        assert [r["prediction"] for r in both] == pytest.approx([r["was"] for r in both], rel=1e-9)
        rest = models[f, spec].transform(df.where(F.col("fold") == f)).collect() if f is not None else []
        assert [got[r["id"]] for r in rest] == pytest.approx([r["prediction"] for r in rest], rel=1e-9)


def test_thresholds_come_from_the_sample_of_the_estimator(spark):
    df = spark.range(40_000, numPartitions=3).select(F.sin("id").alias("x"), (F.col("id") % 9).cast("double").alias("z"), F.when(F.col("id") >= 0, 1.0).alias("same"),
                                                     F.when(F.col("id") > 5, "k").alias("c"), (F.sin("id") ** 2 * 5 + F.col("id") % 9).alias("y")).cache()
    roles = FeatureRoles(("x", "z", "same"), ("c",), (), "y")
    was = Pipeline(stages=[MD.preprocessor(df, roles), boosted(2)]).fit(df).transform(df)
    r = MD.fit_boost(df.select("x", "z", "same", "c", "y"), roles, "y", boosted(2))
    # a written table has its own partitions, so the sample is another one; on the same table the trees are the same
    stats = MD._training_stats(df, roles)
    same = T.fit_boosts(df, roles, "y", None, [T.Boost(2, 5)], stats)[None, T.Boost(2, 5)]
    both = same.transform(was.withColumnRenamed("prediction", "was")).agg(F.max(F.abs(F.col("was") - F.col("prediction")))).first()[0]
    assert both < 1e-9 and len(r.trees) == 2


def test_a_pass_serves_a_level_of_all_training_sets(spark, monkeypatch):
    monkeypatch.setattr(T, "LOCAL_ROWS", 0)
    passes, one = [], T._pass
    monkeypatch.setattr(T, "_pass", lambda *a: passes.append(len(a[1])) or one(*a))
    for folds in (2, 5):
        df = frame(spark, folds=folds).cache()
        T.fit_boosts(df, ROLES, "y", "fold", [T.Boost(3, 3), T.Boost(2, 2, 0.5)], MD._training_stats(df, ROLES, "fold"))
        assert passes == [2 * (folds + 1)] * 9
        passes.clear()


def test_subsample_is_the_same_in_a_task_and_in_passes(spark):
    df = frame(spark).cache()
    stats = MD._training_stats(df, ROLES, "fold")
    specs = [T.Boost(7, 3, 0.2, 0.7), T.Boost(7, 3, 0.2)]
    a, b = (T.fit_boosts(df, ROLES, "y", "fold", specs, stats, local_rows=n) for n in (1_000, 0))
    for key in a:
        p, q = (m[key].transform(df).orderBy("id").toPandas()["prediction"] for m in (a, b))
        assert np.allclose(p, q, rtol=1e-9)
    p, q = (a[None, s].transform(df).orderBy("id").toPandas()["prediction"] for s in specs)
    assert not np.allclose(p, q)


@pytest.mark.parametrize("column", ["x", "y"])
def test_numbers_that_no_tree_can_use_are_refused(spark, column):
    df = frame(spark, 60).withColumn(column, F.when(F.col("id") == 5, float("nan")).otherwise(F.col(column)))
    with pytest.raises(Exception, match="finite|Illegal"):
        MD.cross_fit(df, ROLES, "y", "fold", {"boost": boosted(1)})


def test_ridge_search_joins_its_tables_once(spark, monkeypatch):
    from equiscope.plans import model_q

    folded, read = model_q._folded, spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    monkeypatch.setattr(model_q, "_folded", lambda *a: folded(*a).transform(lambda df: df.mapInPandas(run, df.schema)))
    assert model_q.random_search_ridge(spark, "/root/testdata/sf0.001").count() == 30 and read.value == 6000
