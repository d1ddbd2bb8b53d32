"""Cross-validation from fold Gram matrices: equal to Spark ML fits, odd rows, unseen levels."""

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from equiscope.operators import gram as GR
from equiscope.operators import model as MD
from equiscope.plans.registry import load_all
from equiscope.roles import CANDIDATE_ROLES, FeatureRoles
from equiscope.sources.tables import cand

SF = "/root/testdata/sf0.001"
KEY = ["l_orderkey", "l_linenumber", "salary"]


def test_equal_to_spark_ml_fits_with_the_preprocessor_inside_the_fold(spark):
    df = MD.fold_column(cand(spark, SF).select("l_orderkey", "l_linenumber", "salary", *CANDIDATE_ROLES.features), KEY, 3).cache()
    alphas = [0.0, 1.0, 50.0]
    board, fits = GR.cross_validate(df, CANDIDATE_ROLES, "salary", "fold", alphas)
    got = {r["alpha"]: r for r in board.collect()}
    assert sorted(got) == alphas and len(fits) == 3 * 4
    for alpha in alphas:
        maes = []
        for f in range(3):
            train, held = df.where(F.col("fold") != f), df.where(F.col("fold") == f)
            pre = MD.preprocessor(train, CANDIDATE_ROLES)
            n, sigma = train.agg(F.count("salary"), F.stddev_pop("salary")).first()
            lr = LinearRegression(featuresCol="features", labelCol="salary", elasticNetParam=0.0, standardization=False, solver="normal", regParam=MD.ridge_reg_param(alpha, n, sigma))
            scored = lr.fit(pre.transform(train)).transform(pre.transform(held)).withColumn("p", fits[alpha, f].column())
            worst, mae = scored.agg(F.max(F.abs(F.col("p") - F.col("prediction")) / F.abs("prediction")), F.avg(F.abs(F.col("p") - F.col("salary")))).first()
            # without a penalty the levels are collinear, and Spark's solver turns to iterations
            assert worst < (1e-6 if alpha else 1e-4), (alpha, f, worst)
            maes.append(mae)
        assert abs(got[alpha]["cv_mae"] / np.mean(maes) - 1) < (1e-7 if alpha else 1e-5) and abs(got[alpha]["cv_mae_std"] - np.std(maes)) < 1e-5 * np.mean(maes)


ROLES = FeatureRoles(numerical=("x", "z"), categorical=("c",), protected=(), target="y")


def rows(n=60):
    rng = np.random.default_rng(1)
    out = []
    for i in range(n):
        x, z, c = float(rng.normal()), float(rng.normal(5)), "abc"[i % 3]
        out.append((i, None if i % 7 == 0 else x, float("nan") if i % 11 == 0 else z, None if i % 13 == 0 else c, 3 * x + z + i % 3, i % 4))
    return out


def test_missing_numbers_levels_and_labels(spark):
    schema = "id long, x double, z double, c string, y double, fold int"
    data = rows() + [(100, 1.0, 1.0, "only in fold 0", 9.0, 0), (101, None, None, None, None, 1), (102, 1.0, 1.0, "a", 1.0, None)]
    df = spark.createDataFrame(data, schema)
    grams = GR.fold_grams(df, ROLES, "y", "fold")
    assert sorted(grams.folds) == [0, 1, 2, 3] and grams.of_training(None)[grams.names.index(GR.ONE), grams.names.index(GR.ONE)] == 61
    board, fits = GR.cross_validate(df, ROLES, "y", "fold", [0.5])
    table = {r["id"]: r["p_ridge"] for r in GR.out_of_fold(df, {"ridge": {f: fit for (_, f), fit in fits.items() if f is not None}}, "fold").collect()}
    assert table[102] is None and all(v is not None for i, v in table.items() if i != 102)
    maes = []
    for f in range(4):  # by hand
        usable = [r for r in data if r[4] is not None and r[5] is not None]
        train = [r for r in usable if r[5] != f]
        num = lambda v: np.nan if v is None else v
        a = np.array([[num(r[1]), num(r[2])] for r in train])
        medians = np.nanmedian(a, 0)
        levels = sorted({r[3] for r in train if r[3] is not None})
        mode = min(levels, key=lambda c: (-sum(r[3] == c for r in train), c))
        a = np.where(np.isnan(a), medians, a)
        mean, std = a.mean(0), a.std(0)

        def design(rows):
            b = np.array([[num(r[1]), num(r[2])] for r in rows])
            return np.c_[(np.where(np.isnan(b), medians, b) - mean) / std, np.array([[float((r[3] or mode) == c) for c in levels] for r in rows])]

        x, y = design(train), np.array([r[4] for r in train])
        xc, yc = x - x.mean(0), y - y.mean()
        w = np.linalg.solve(xc.T @ xc + 0.5 * np.eye(x.shape[1]), xc.T @ yc)
        held = [r for r in usable if r[5] == f]
        p = (design(held) - x.mean(0)) @ w + y.mean()
        assert np.allclose(p, [table[r[0]] for r in held])
        maes.append(np.abs(p - [r[4] for r in held]).mean())
    assert abs(board.first()["cv_mae"] - np.mean(maes)) < 1e-9


def test_one_fold_and_no_rows(spark):
    df = spark.createDataFrame(rows(), "id long, x double, z double, c string, y double, fold int")
    assert GR.cross_validate(df.withColumn("fold", F.lit(0)), ROLES, "y", "fold", [1.0])[0].count() == 0
    assert GR.cross_validate(df.limit(0), ROLES, "y", "fold", [1.0])[0].count() == 0
    constant = df.withColumn("x", F.lit(2.0)).withColumn("c", F.lit(None).cast("string"))
    fit = GR.cross_validate(constant, ROLES, "y", "fold", [0.0])[1][0.0, 0]
    assert fit.levels == {"c": {}} and fit.modes == {"c": None} and abs(fit.numbers["x"][0]) < 1e-9


@pytest.mark.parametrize("name", ["train_compare", "random_search_ridge", "stacking_voting"])
def test_learners_run_as_queries(spark, name):
    found = load_all()[name].build(spark, SF).collect()
    assert found and all(r["cv_mae" if name == "random_search_ridge" else "test_mae" if name == "train_compare" else "mae"] > 0 for r in found)
    if name == "random_search_ridge":
        assert len(found) == 30
    if name == "train_compare":
        board = {r["model"]: r for r in found}
        assert set(board) == {"linear_regression", "ridge", "random_forest", "gradient_boosting", "voting", "stacking"}
        base = [r for m, r in board.items() if m not in ("voting", "stacking")]
        best = min(base, key=lambda r: (r["cv_mae"], r["model"]))
        assert {r["best_model"] for r in found} == {best["model"]} and sum(r["in_ensemble"] for r in found) == 3
        assert all(board[m]["beats_best_base"] == (board[m]["test_mae"] < min(r["test_mae"] for r in base)) for m in ("voting", "stacking"))
