"""Versions appear whole or not at all; runs from stored artefacts equal those from the training rows."""

import os
import statistics

import pytest
from pyspark.sql import functions as F

from equiscope.operators import artefacts as AF
from equiscope.operators import drift, gram
from equiscope.roles import FeatureRoles
from equiscope.session import ensure_checkpoint_dir

ROLES = FeatureRoles(numerical=("x", "z"), categorical=("c",), protected=("g",), target="y", prediction="p")


def _root(spark):
    return f"{ensure_checkpoint_dir(spark)}/store-{os.urandom(4).hex()}"


def _rows(spark, n=300):
    part = lambda i: ("train", "train", "calibration", "test")[i % 4]
    rows = [(i, float(i % 17) if i % 13 else None, float(i * i % 23), ["a", "b", None][i % 3], "mw"[i % 2], 5.0 * (i % 17) + (i * 7 % 11), part(i)) for i in range(n)]
    return spark.createDataFrame(rows, "i int, x double, z double, c string, g string, y double, split string")


def test_versions_are_whole_and_never_overwritten(spark):
    root = _root(spark)
    one = spark.createDataFrame([(1,)], "a int")
    assert AF.versions(spark, root) == [] and AF.load(spark, root) is None
    with pytest.raises(Exception):  # a table that can't be written: no version
        AF.publish(root, "v1", {"t": one.select(F.raise_error(F.lit("lost")).alias("a"))}, {}, spark)
    assert AF.versions(spark, root) == []
    AF.publish(root, "v1", {"t": one}, {"q": 1.5}, spark)
    with pytest.raises(ValueError):
        AF.publish(root, "v1", {"t": one.selectExpr("a + 1 AS a")}, {"q": 2.5}, spark)
    got = AF.load(spark, root)
    assert (got.version, got.values, got.tables["t"].collect()[0]["a"]) == ("v1", {"q": 1.5}, 1)
    assert AF.load(spark, root, "v2") is None
    for name in ("", "../x", ".hidden", "a/b"):
        with pytest.raises(ValueError):
            AF.publish(root, name, {"t": one}, {}, spark)
    with pytest.raises(ValueError):  # a metric that is no number
        AF.publish(root, "v3", {"t": one}, {"q": float("nan")}, spark)
    assert AF.versions(spark, root) == ["v1"]


def test_runs_from_the_store(spark):
    df = _rows(spark)
    stored = AF.train_and_publish(_root(spark), "m-1", df, ROLES, "y", "split", alpha=1.0)
    train = df.where("split = 'train'").withColumn("f", F.lit(0))
    grams = gram.fold_grams(train, ROLES, "y", "f")
    median = {c: statistics.median(r[c] for r in train.where(f"{c} IS NOT NULL").collect()) for c in "xz"}  # z has no gap in training
    fit = gram.fit_gram(grams.names, grams.of_training(None), 1.0, median)
    assert fit.numbers["z"][1] == median["z"] and AF.model_from(stored.tables["model"]) == fit  # to the last bit, with fills and modes
    odd = df.withColumn("predicted", F.lit("clash")).unionByName(spark.createDataFrame([(999, None, None, "unseen", None, None, "test", "clash")], df.schema.simpleString()[7:-1].replace(":", " ") + ", predicted string"))
    scored = {r["i"]: r for r in AF.score(odd, stored).withColumn("want", fit.column()).collect()}
    assert len(scored) == 301 and all(r["predicted"] == r["want"] and r["model_version"] == "m-1" for r in scored.values())
    q = stored.values["q_hat"]
    assert all(r["min_salary"] == max(0.0, r["predicted"] - q) and r["max_salary"] == r["predicted"] + q for r in scored.values())
    off = sorted(abs(r["y"] - r["predicted"]) for r in scored.values() if r["split"] == "calibration")
    assert q in off and sum(o <= q for o in off) >= 0.9 * len(off)

    board = {(r["attribute"], r["group"]): r for r in AF.evaluate(odd.where("split = 'test'"), stored, ["g", "c"], "y").collect()}
    assert set(board) == {("overall", "all"), ("g", "w"), ("c", "a"), ("c", "b")}  # the odd rows of the test split are of one group
    test = [r for r in scored.values() if r["split"] == "test" and r["y"] is not None]
    assert board["overall", "all"]["count"] == len(test)
    assert board["overall", "all"]["mae"] == pytest.approx(sum(abs(r["predicted"] - r["y"]) for r in test) / len(test))
    assert board["overall", "all"]["mae"] == pytest.approx(stored.values["mae"])


def test_stored_drift_equals_shared_edges_on_the_reference_range(spark):
    df = _rows(spark)
    stored = AF.train_and_publish(_root(spark), "m-2", df, ROLES, "y", "split")
    train = df.where("split = 'train'")
    same = {r["feature"]: r["psi"] for r in AF.drift_from(train, stored, ROLES).collect()}
    assert set(same) == {"x", "z", "c", "p"} and all(abs(v) < 1e-12 for v in same.values())
    inside = train.where("x < 10 AND c = 'a'").unionByName(train.orderBy("x").limit(5))  # within the range: the shared edges are the reference's
    got = {r["feature"]: r for r in AF.drift_from(inside, stored, ROLES).collect()}
    both = train.withColumn("_s", F.lit(0)).unionByName(inside.withColumn("_s", F.lit(1)))
    want = {r["feature"]: r["psi"] for r in drift.psi_numeric(drift.long_numeric_sided(both, "_s", ["x", "z"])).collect()}
    want |= {r["feature"]: r["psi"] for r in drift.psi_categorical(drift.long_categorical_sided(both, "_s", ["c"])).collect()}
    for f in ("x", "z", "c"):
        assert got[f]["psi"] == pytest.approx(want[f], rel=1e-9)
    assert got["c"]["drift_level"] == "high"
    beyond = AF.drift_from(train.withColumn("x", F.col("x") + 1000), stored, ROLES).where("feature = 'x'").first()
    assert beyond["drift_level"] == "high" and AF.drift_from(train.where("false"), stored, ROLES).count() == 0


def test_what_cannot_be_published(spark):
    df = _rows(spark)
    with pytest.raises(ValueError):
        AF.train_and_publish(_root(spark), "m", df.where("split <> 'train'"), ROLES, "y", "split")
    with pytest.raises(ValueError):  # no calibration rows
        AF.train_and_publish(_root(spark), "m", df.where("split <> 'calibration'"), ROLES, "y", "split")
