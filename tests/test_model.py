"""Model pipeline, ridge parameterisation and attribution identities."""
import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from equiscope.operators import attribution as AT
from equiscope.operators import model as MD
from equiscope.roles import FeatureRoles

ROLES = FeatureRoles(("exp", "score"), ("edu",), ("gender",), "salary")


def _frame(spark):
    rows = [(1.0, 7.0, "Bachelor", "F", 50.0), (2.0, None, "Master", "M", 60.0),
            (None, 9.0, "PhD", "F", 80.0), (4.0, 6.0, "Bachelor", "M", 65.0),
            (5.0, 8.0, None, "F", 75.0), (10.0, 7.5, "Master", "M", 100.0)]
    return spark.createDataFrame(rows, "exp double, score double, edu string, gender string, salary double")


def test_preprocessor_imputes_and_zeroes_unknown(spark):
    df = _frame(spark)
    pre = MD.preprocessor(df, ROLES)
    names = MD.feature_names(pre, ROLES)
    assert names == ["exp", "score", "edu_Bachelor", "edu_Master", "edu_PhD"]
    out = pre.transform(df).select(vector_to_array("features").alias("v")).collect()
    assert all(not np.isnan(x) for r in out for x in r["v"])  # NULLs imputed
    unk = spark.createDataFrame([(3.0, 7.0, "Unknown Degree", "F", 1.0)], df.schema)
    v = pre.transform(unk).select(vector_to_array("features").alias("v")).first()["v"]
    assert v[2:] == [0.0, 0.0, 0.0]  # unknown category -> all-zero block
    # NULL category is imputed with the mode (ties -> smallest): Bachelor/Master tie -> Bachelor
    vnull = pre.transform(df.where(F.col("edu").isNull())).select(
        vector_to_array("features").alias("v")).first()["v"]
    assert vnull[2:] == [1.0, 0.0, 0.0]


def test_protected_columns_cannot_be_features(spark):
    from equiscope.operators.features import select_features
    with pytest.raises(ValueError):
        select_features(_frame(spark), ROLES, extra=("gender",))


def test_ridge_reg_param_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 3))
    y = X @ np.array([2.0, -1.0, 0.5]) + rng.normal(size=200) * 0.3 + 4.0
    alpha = 5.0
    Xc, yc = X - X.mean(0), y - y.mean()
    beta = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(3), Xc.T @ yc)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(t)) for (a, b, c), t in zip(X, y)],
                               "a double, b double, c double, y double")
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(df)
    reg = MD.ridge_reg_param(alpha, len(y), float(np.std(y)))
    m = LinearRegression(featuresCol="f", labelCol="y", elasticNetParam=0.0, standardization=False,
                         solver="normal", regParam=reg).fit(data)
    assert np.allclose(m.coefficients.toArray(), beta, atol=1e-6)


def test_linear_attribution_identity(spark):
    df = _frame(spark)
    a = AT.linear_attribution(df, {"exp": 3.0, "score": -2.0}, 10.0)
    rows = a.select("base_value", "prediction",
                    F.aggregate(AT.CONTRIB, F.lit(0.0), lambda acc, c: acc + c["contribution"]).alias("s")
                    ).collect()
    for r in rows:
        assert r["base_value"] + r["s"] == pytest.approx(r["prediction"])
    # base value is the mean prediction
    assert np.mean([r["prediction"] for r in rows]) == pytest.approx(rows[0]["base_value"])


def test_permutation_shapley_efficiency(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), float(2 * i + (i % 3))) for i in range(30)],
                               "a double, b double, y double")
    from pyspark.ml import Pipeline
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"),
                             LinearRegression(featuresCol="features", labelCol="y")]).fit(df)
    rows = df.withColumn("id", F.monotonically_increasing_id()).where(F.col("a") < 4)
    bg = df.where(F.col("a") >= 26)
    phi = AT.permutation_shapley(model, rows, bg, ["id"], ["a", "b"], permutations=3)
    total = {r["id"]: r["s"] for r in phi.groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    fx = {r["id"]: r["prediction"] for r in model.transform(rows).collect()}
    fb = np.mean([r["prediction"] for r in model.transform(bg).collect()])
    for i, s in total.items():
        assert s == pytest.approx(fx[i] - fb, abs=1e-6)


def test_random_search_ridge_runs_30_trials_over_alpha(spark):
    from equiscope.plans.model_q import _model_frame, random_search_ridge
    sf = "/root/testdata/sf0.001"
    n, sigma = _model_frame(spark, sf).agg(F.count("salary"), F.stddev_pop("salary")).first()
    rows = random_search_ridge(spark, sf).collect()
    alphas = [r["reg_param"] / sigma * n * 2 / 3 for r in rows]
    assert len(rows) == 30 and all(0.009 < a < 101 for a in alphas) and max(alphas) > 10 * min(alphas)
    assert all(r["cv_mae"] > 0 for r in rows)
