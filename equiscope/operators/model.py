"""Feature pipeline, estimators, search, ensembles and scoring on Spark ML.

Fitting statistics are computed by our own single aggregation (exact medians
via distributed selection, modes with a deterministic tie rule, population
std), then frozen into a ``PipelineModel`` of stock stages so the fitted
pipeline saves/loads with ``MLWriter`` and scores as ordinary projections.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import (OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler)
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..roles import METRIC_NAME_MAP, FeatureRoles
from ..session import held, written
from . import gram, quantile, trees


# ------------------------------------------------------------------------- M1
@dataclass
class PreprocessorStats:
    medians: dict
    means: dict
    stds: dict
    modes: dict


def fit_preprocessor_stats(df: DataFrame, roles: FeatureRoles) -> PreprocessorStats:
    """Median (exact) and most-frequent (ties → smallest) imputation values;
    mean and *population* std of the imputed numerics (T12)."""
    with held(df.select(*roles.numerical, *roles.categorical)) as rows:
        return PreprocessorStats(*_number_stats(rows, roles)[None], most_frequent(rows, roles.categorical))


def _number_stats(df: DataFrame, roles: FeatureRoles, fold: str | None = None) -> dict[int | None, tuple[dict, dict, dict]]:
    """(medians, means, stds) of the imputed numbers over all rows (None) and over the rows outside each fold.

    One scan gives count, mean and variance per fold; those of a training set,
    its missing values standing at the median, follow from its folds'.
    """
    if not roles.numerical:
        return _each_set(df, fold, lambda _: ({}, {}, {}))
    medians = quantile.column_quantiles(df, roles.numerical, [0.5], fold)
    side = F.col(fold).cast("int") if fold else F.lit(None).cast("int")
    wide = df.groupBy(side.alias("f")).agg(F.count(F.lit(1)).alias("n"), *[
        agg(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(roles.numerical) for k, agg in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]).collect()

    def of(s):
        mid, mean, std = {}, {}, {}
        for i, c in enumerate(roles.numerical):
            mid[c] = medians[c, s][0]
            mine = [r for r in wide if s is None or (r["f"] is not None and r["f"] != s)]
            parts = [(r[f"n{i}"], r[f"m{i}"], r[f"v{i}"]) for r in mine if r[f"n{i}"]]
            gaps = sum(r["n"] - r[f"n{i}"] for r in mine)
            if gaps and mid[c] is not None:
                parts.append((gaps, mid[c], 0.0))
            n = sum(p[0] for p in parts)
            mean[c] = std[c] = None
            if n:
                mean[c] = math.fsum(p[0] * p[1] for p in parts) / n
                std[c] = math.sqrt(math.fsum(p[0] * (p[2] + (p[1] - mean[c]) ** 2) for p in parts) / n)
        return mid, mean, std

    return {s: of(s) for s in {s for _, s in medians}}


def _each_set(df: DataFrame, fold: str | None, of) -> dict:
    folds = [r[0] for r in df.select(F.col(fold).cast("int")).distinct().collect() if r[0] is not None] if fold else []
    return {s: of(s) for s in (None, *folds)}


def _training_stats(df: DataFrame, roles: FeatureRoles, fold: str | None = None) -> dict[int | None, tuple[PreprocessorStats, dict[str, list[str]]]]:
    """Statistics and levels of all rows (None) and of the rows outside each fold, from passes that all sets share."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in roles.categorical])
    side = F.col(fold).cast("int") if fold else F.lit(None).cast("int")
    counts = [] if not roles.categorical else (
        df.select(side.alias("f"), F.explode(cells).alias("cv")).select("f", "cv.column", "cv.v").where(F.col("v").isNotNull())
        .groupBy("f", "column", "v").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a level and fold, as the indexer keeps them
    out = {}
    for s, numbers in _number_stats(df, roles, fold).items():
        levels: dict[str, dict[str, int]] = {c: {} for c in roles.categorical}
        for r in counts:
            if s is None or (r["f"] is not None and r["f"] != s):
                levels[r["column"]][r["v"]] = levels[r["column"]].get(r["v"], 0) + r["n"]
        modes = {c: min(of, key=lambda v: (-of[v], v.encode())) if of else None for c, of in levels.items()}
        out[s] = PreprocessorStats(*numbers, modes), {c: list(of) for c, of in levels.items()}
    return out


def most_frequent(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most frequent non-NULL value per column, ties → smallest value.

    Counts per (column, value) are a partial-aggregated group-by; the pick is an
    algebraic ``min_by`` over those counts, so no task holds a column's values.
    """
    if not cols:
        return {}
    long = (df.select(F.explode(F.array(*[
                F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols]))
                .alias("cv")).select("cv.column", "cv.v").where(F.col("v").isNotNull()))
    counts = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy("column").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("mode")).collect()
    out = {c: None for c in cols}
    out.update({r["column"]: r["mode"] for r in rows})  # one row per column
    return out


def _q(name: str) -> str:
    return f"`{name}`"


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(float(v)) + "D"


def preprocessor(df: DataFrame, roles: FeatureRoles, output: str = "features") -> PipelineModel:
    """Fitted preprocessor: impute → standardise numerics, impute → one-hot
    categoricals (unknown/NULL ⇒ all-zero block), assemble ``output``."""
    with held(df.select(*roles.numerical, *roles.categorical)) as rows:
        st, levels = _training_stats(rows, roles)[None]
    return _frozen(df, st, levels, roles, output)


def _frozen(df: DataFrame, st: PreprocessorStats, levels: dict[str, list[str]], roles: FeatureRoles, output: str = "features") -> PipelineModel:
    """The preprocessor of these statistics and levels; ``df`` gives the schema only."""
    exprs = []
    for c in roles.numerical:
        sd = st.stds[c] if st.stds[c] not in (None, 0.0) else 1.0
        exprs.append(f"(coalesce(CAST({_q(c)} AS DOUBLE), {_lit(st.medians[c])}) - {_lit(st.means[c])})"
                     f" / {_lit(sd)} AS {_q('_n_' + c)}")
    for c in roles.categorical:
        exprs.append(f"coalesce({_q(c)}, {_lit(st.modes[c])}) AS {_q('_c_' + c)}")
    sql = SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")
    idx = StringIndexer(inputCols=[f"_c_{c}" for c in roles.categorical],
                        outputCols=[f"_i_{c}" for c in roles.categorical],
                        stringOrderType="alphabetAsc", handleInvalid="keep")
    # the indexer maps unknown labels to the last index; dropLast removes that
    # slot, so an unknown category encodes as an all-zero block
    ohe = OneHotEncoder(inputCols=[f"_i_{c}" for c in roles.categorical],
                        outputCols=[f"_o_{c}" for c in roles.categorical], dropLast=True)
    asm = VectorAssembler(inputCols=[f"_n_{c}" for c in roles.numerical]
                          + [f"_o_{c}" for c in roles.categorical], outputCol=output)
    # the stages are fitted on a row per level, which is all they learn from
    schema = df.select(*roles.numerical, *[F.col(c).cast("string").alias(c) for c in roles.categorical]).schema
    most = max([len(v) for v in levels.values()], default=0)
    table = [(*[None] * len(roles.numerical), *[levels[c][i] if i < len(levels[c]) else st.modes[c] for c in roles.categorical]) for i in range(max(most, 1))]
    return Pipeline(stages=[sql, idx, ohe, asm]).fit(df.sparkSession.createDataFrame(table, schema))


def feature_names(pre: PipelineModel, roles: FeatureRoles) -> list[str]:
    """Names of the assembled vector's slots, in order."""
    idx = [s for s in pre.stages if s.__class__.__name__ == "StringIndexerModel"][0]
    names = list(roles.numerical)
    for c, labels in zip(roles.categorical, idx.labelsArray):
        names += [f"{c}_{lab}" for lab in labels]
    return names


# --------------------------------------------------------------------- M3-M6
def ridge_reg_param(alpha: float, n: int, sigma_y_pop: float) -> float:
    """Spark's regParam equal to a closed-form ridge with penalty α."""
    return alpha / n * sigma_y_pop


def estimators(label: str = "salary", features: str = "features", seed: int = 42) -> dict:
    return {
        "linear_regression": LinearRegression(featuresCol=features, labelCol=label, regParam=0.0,
                                              solver="auto"),
        "ridge": LinearRegression(featuresCol=features, labelCol=label, elasticNetParam=0.0,
                                  standardization=False, solver="auto"),
        "random_forest": RandomForestRegressor(featuresCol=features, labelCol=label, seed=seed),
        "gradient_boosting": GBTRegressor(featuresCol=features, labelCol=label, seed=seed),
    }


# --------------------------------------------------------------------- M7/M8
def fold_column(df: DataFrame, key: Sequence[str], k: int, seed: int = 42, col: str = "fold") -> DataFrame:
    """Key-stable fold assignment (hash of the key), so CV is reproducible."""
    return df.withColumn(col, F.pmod(F.xxhash64(*[F.col(c) for c in key], F.lit(seed)), F.lit(k)).cast("int"))


def random_param_maps(est, space: dict, trials: int, seed: int = 42) -> list[dict]:
    """Seeded random search over the same kinds of ranges as the reference's
    sequential search: ('log', lo, hi) log-uniform, ('int', lo, hi), ('cat', [..])."""
    rng = random.Random(seed)
    maps = []
    for _ in range(trials):
        pm = {}
        for name, spec in space.items():
            p = est.getParam(name)
            if spec[0] == "log":
                pm[p] = math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2])))
            elif spec[0] == "int":
                pm[p] = rng.randint(spec[1], spec[2])
            else:
                pm[p] = rng.choice(spec[1])
        maps.append(pm)
    return maps


def cross_validate(est, grid: list, df: DataFrame, label: str, fold_col: str = "fold",
                   parallelism: int = 2) -> tuple:
    """Fit with k-fold CV on a fold column; returns (best model, avg MAE, std MAE per map)."""
    ev = RegressionEvaluator(labelCol=label, predictionCol=est.getPredictionCol(), metricName="mae")
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid or [{}], evaluator=ev,
                        foldCol=fold_col, parallelism=parallelism, collectSubModels=False)
    m = cv.fit(df)
    return m, list(m.avgMetrics), list(m.stdMetrics)


# ------------------------------------------------------------------------- M9
def voting(df: DataFrame, pred_cols: Sequence[str], out: str = "prediction") -> DataFrame:
    """Mean of base predictions."""
    s = None
    for c in pred_cols:
        s = F.col(c) if s is None else s + F.col(c)
    return df.withColumn(out, s / F.lit(float(len(pred_cols))))


def cross_fit(df: DataFrame, roles: FeatureRoles, label: str, fold_col: str, learners: dict) -> tuple[DataFrame, dict]:
    """Out-of-fold predictions: ``df`` with ``p_<name>`` per learner, each row
    predicted by models (and a preprocessor) fitted on the other folds, and the
    same learners fitted on all rows as ``{name: PipelineModel | LinearFit}``.

    A learner is an estimator of Spark ML, or a number: the penalty of a linear
    model, whose fits all come from one scan (``gram``). Boosted trees of all
    training sets are grown in passes they share (``trees``). Folds are few and
    given by ``fold_col``; the table is written before it is returned, so
    readers don't fit again.
    """
    with held(df) as df:
        linear = {n: e for n, e in learners.items() if not hasattr(e, "fit")}
        boosted = {n: of for n, e in learners.items() if n not in linear and (of := boost_of(e))}
        others = {n: e for n, e in learners.items() if n not in linear and n not in boosted}
        folds = sorted(r[0] for r in df.select(fold_col).distinct().collect())
        fitted, by_fold = {}, {}
        if linear:
            _, fits = gram.fold_fits(df, roles, label, fold_col, list(dict.fromkeys(linear.values())))
            for n, alpha in linear.items():
                by_fold[n] = {f: fits[alpha, f] for f in folds}
                fitted[n] = fits[alpha, None]
        table = gram.out_of_fold(df, by_fold, fold_col)
        names = [f"p_{n}" for n in learners]
        stats = _training_stats(df, roles, fold_col) if boosted or others else {}
        if boosted:
            by_learner = {n: {} for n in boosted}
            for kind in dict.fromkeys(kind for _, kind in boosted.values()):
                grown = trees.fit_boosts(df, roles, label, fold_col, [spec for spec, k in boosted.values() if k == kind], stats, **dict(kind))
                for n, (spec, k) in boosted.items():
                    if k == kind:
                        by_learner[n] = {s: replace(grown[s, spec], output=f"p_{n}") for s in (None, *folds)}
            table = trees.with_predictions(table, {}, fold_col, {f"p_{n}": {f: m[f] for f in folds} for n, m in by_learner.items()})
            fitted |= {n: m[None] for n, m in by_learner.items()}
        if others:
            pres = {s: _frozen(df, *stats[s], roles) for s in (None, *folds)}

            def fit(s):
                train = df if s is None else df.where(F.col(fold_col) != s)
                ready = pres[s].transform(train).select("features", label).persist(StorageLevel.MEMORY_AND_DISK)  # an estimator scans its input several times
                try:
                    return {n: PipelineModel([pres[s], e.copy().setPredictionCol(f"p_{n}").fit(ready)]) for n, e in others.items()}
                finally:
                    ready.unpersist()

            with ThreadPool(3) as pool:  # a level of a small tree leaves cores idle
                models = dict(zip((None, *folds), pool.map(inheritable_thread_target(df.sparkSession)(fit), (None, *folds), chunksize=1)))
            parts = [predicted(table.where(F.col(fold_col) == f), models[f]) for f in folds]
            table = parts[0]
            for part in parts[1:]:
                table = table.unionByName(part)
            fitted |= models[None]
        return written(table.select(*df.columns, *names)), fitted


def boost_of(est) -> tuple[trees.Boost, tuple] | None:
    """(model, how its bins are made) of a ``GBTRegressor`` whose settings ``trees`` knows."""
    if not isinstance(est, GBTRegressor):
        return None
    known = (est.getLossType() == "squared" and est.getFeatureSubsetStrategy() == "all" and est.getMinInfoGain() == 0 and est.getMinWeightFractionPerNode() == 0
             and not est.isDefined(est.weightCol) and not est.isDefined(est.validationIndicatorCol) and est.getMaxDepth() > 0)
    spec = trees.Boost(est.getMaxIter(), est.getMaxDepth(), est.getStepSize(), est.getSubsamplingRate(), est.getMinInstancesPerNode(), est.getSeed())
    return (spec, (("bins", est.getMaxBins()), ("seed", est.getSeed()))) if known else None


def fit_boost(df: DataFrame, roles: FeatureRoles, label: str, est: GBTRegressor) -> trees.BoostFit:
    """The preprocessor and ``est`` fitted on all rows, in passes over a written table."""
    spec, kind = boost_of(est)
    with held(df.select(*roles.numerical, *roles.categorical, label)) as df:
        return trees.fit_boosts(df, roles, label, None, [spec], _training_stats(df, roles), **dict(kind))[None, spec]


def predicted(df: DataFrame, models: dict) -> DataFrame:
    """``df`` with ``p_<name>`` per fitted model of ``cross_fit``."""
    out = df
    for n, m in models.items():
        if isinstance(m, gram.LinearFit):
            out = out.withColumn(f"p_{n}", m.column())
        else:
            out = m.transform(out).select(*out.columns, f"p_{n}")
    return out


def stack(oof: DataFrame, names: Sequence[str], label: str, alpha: float = 1.0) -> gram.LinearFit:
    """The ridge meta-learner over out-of-fold predictions, unscaled as the reference's (from sums of products, one scan)."""
    roles = FeatureRoles(tuple(f"p_{n}" for n in names), (), (), label)
    sums = gram.fold_grams(oof.withColumn("_all", F.lit(0)), roles, label, "_all")
    return gram.fit_gram(sums.names, sums.of_training(None), alpha, {}, scale=False)


# ------------------------------------------------------------------------ M10
def score(model: Transformer, df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Batch scoring: the input row is kept, one prediction column is added."""
    return model.transform(df).withColumnRenamed(model.getOrDefault("predictionCol")
                                                 if hasattr(model, "getOrDefault") else "prediction",
                                                 prediction)


# ------------------------------------------------------------------------ M12
def train_compare(df: DataFrame, roles: FeatureRoles, label: str, key: Sequence[str], k: int = 5, tuning_folds: int = 3,
                  ridge_alphas: Sequence[float] = (0.1, 1.0, 10.0, 100.0), seed: int = 42,
                  rf_trees: Sequence[int] = (20,), rf_depths: Sequence[int] = (8,), gbt_iters: Sequence[int] = (20,), gbt_depths: Sequence[int] = (3,),
                  top: int = 3) -> DataFrame:
    """Leaderboard of the model families and of the ensembles of the best ``top``.

    A fifth of the rows (by hash) is held out. On the others each family is
    tuned over its grid with ``tuning_folds`` folds and reported with ``k``
    folds of out-of-fold predictions; preprocessors are fitted inside the folds.
    Families are ranked by CV error, never by the test rows (T15). Voting and
    stacking combine the best; the meta-learner reads out-of-fold predictions.
    ``beats_best_base`` is the verdict on an ensemble (O4): a lower test MAE
    than every family.
    """
    from .metrics import regression_metrics
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in key], F.lit(seed + 1)), F.lit(5))
    split = fold_column(fold_column(df, key, k, seed, "_fold"), key, tuning_folds, seed + 2, "_tuning").withColumn("_bucket", bucket)
    with held(split) as split:
        train, test = (split.where(cond).drop("_bucket") for cond in ("_bucket <> 0", "_bucket = 0"))
        est = estimators(label, seed=seed)
        tuned = {"linear_regression": 0.0}
        board, _ = gram.cross_validate(train, roles, label, "_tuning", list(ridge_alphas))
        tuned["ridge"] = board.orderBy("cv_mae", "alpha").first()["alpha"]
        grids = {
            "random_forest": ParamGridBuilder().addGrid(est["random_forest"].numTrees, list(rf_trees))
                                               .addGrid(est["random_forest"].maxDepth, list(rf_depths)).build(),
            "gradient_boosting": ParamGridBuilder().addGrid(est["gradient_boosting"].maxIter, list(gbt_iters))
                                                   .addGrid(est["gradient_boosting"].maxDepth, list(gbt_depths)).build(),
        }
        for name, grid in grids.items():
            points = [est[name].copy(point) for point in grid]
            if len(points) > 1:
                oof, _ = cross_fit(train, roles, label, "_tuning", {str(i): p for i, p in enumerate(points)})
                maes = _fold_errors(oof, label, "_tuning", [str(i) for i in range(len(points))])
                points = [points[int(min(maes, key=lambda i: (maes[i][0], int(i))))]]
            tuned[name] = points[0]
        oof, fitted = cross_fit(train, roles, label, "_fold", tuned)
        cv = _fold_errors(oof, label, "_fold", list(tuned))
        chosen = sorted(cv, key=lambda n: (cv[n][0], n))[:top]
        meta = stack(oof, chosen, label)
        voted = lambda t: voting(t, [f"p_{n}" for n in chosen], "p_voting").withColumn("p_stacking", meta.column())
        cv |= {"voting": _fold_errors(voted(oof), label, "_fold", ["voting"])["voting"], "stacking": (None, None)}
        rows = []
        with held(voted(predicted(test, fitted)).select(label, *[f"p_{name}" for name in cv])) as scored:
            for name in cv:
                tm = regression_metrics(scored, label, f"p_{name}").first()
                rows.append([name, cv[name][0], cv[name][1], float(tm["mae"]), float(tm["rmse"]), None if tm["r2"] is None else float(tm["r2"]), name in chosen])
    least = min(r[3] for r in rows if r[0] in fitted)
    rows = [(*r, None if r[0] in fitted else r[3] < least) for r in rows]
    return spark.createDataFrame(rows, "model string, cv_mae double, cv_mae_std double, test_mae double, test_rmse double, test_r2 double, "
                                       "in_ensemble boolean, beats_best_base boolean")


def _fold_errors(oof: DataFrame, label: str, fold_col: str, names: Sequence[str]) -> dict:
    """{name: (mean, population deviation) of the folds' MAE} from a table of out-of-fold predictions, in one scan."""
    per = oof.groupBy(fold_col).agg(*[F.avg(F.abs(F.col(f"p_{n}") - F.col(label))).alias(f"e_{n}") for n in names])
    r = per.agg(*[x for n in names for x in (F.avg(f"e_{n}").alias(f"m_{n}"), F.stddev_pop(f"e_{n}").alias(f"s_{n}"))]).first()
    return {n: (r[f"m_{n}"], r[f"s_{n}"]) for n in names}


def leaderboard(board: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Model families ordered by CV MAE; (top-k, best-model row)."""
    board = board.where("beats_best_base IS NULL") if "beats_best_base" in board.columns else board
    top = board.orderBy("cv_mae", "model").limit(k)
    best = board.agg(F.min_by("model", F.struct("cv_mae", "model")).alias("best_model"),
                     F.min("cv_mae").alias("best_cv_mae"))
    return top, best


# ------------------------------------------------------------------------- O5
def normalize_metrics(df: DataFrame, pairs=METRIC_NAME_MAP, keep: Sequence[str] = ()) -> DataFrame:
    """Normalised metric columns: for each target name, the first listed source
    column that exists and is non-NULL (``coalesce`` in list order); targets
    with no source are NULL, so the schema is fixed."""
    targets = list(dict.fromkeys(dst for _, dst in pairs))
    cols = []
    for dst in targets:
        srcs = [F.col(src).cast("double") for src, d in pairs if d == dst and src in df.columns]
        cols.append((F.coalesce(*srcs) if srcs else F.lit(None).cast("double")).alias(dst))
    return df.select(*keep, *cols)
