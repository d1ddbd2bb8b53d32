"""Additive feature attribution (AT1-AT4, O2, O3, P20).

Linear models: the exact Shapley value of feature j is β_j·(x_j − E[x_j])
and the base value is the mean prediction, so base + Σ contributions equals
the prediction row by row. The attribution is one projection building an
array<struct<feature, contribution>> per row — no shuffle; global importance
is one grouped aggregate over the exploded array.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dlit

CONTRIB = "contributions"


def linear_attribution(df: DataFrame, coef: Mapping[str, float], intercept: float,
                       means: Mapping[str, float] | None = None) -> DataFrame:
    """AT1 on raw numeric columns. NULL inputs are imputed with the mean
    (contribution 0). Adds base_value, prediction and ``contributions``."""
    feats = list(coef)
    if means is None:
        row = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in feats]).first()
        means = {f: row[f] for f in feats}
    x = {f: F.coalesce(F.col(f).cast("double"), dlit(means[f])) for f in feats}
    contribs = F.array(*[F.struct(F.lit(f).alias("feature"),
                                  (dlit(coef[f]) * (x[f] - dlit(means[f]))).alias("contribution"))
                         for f in feats])
    pred = dlit(intercept)
    for f in feats:
        pred = pred + dlit(coef[f]) * x[f]
    base = dlit(intercept)
    for f in feats:
        base = base + dlit(coef[f]) * dlit(means[f])
    return df.withColumn("base_value", base).withColumn("prediction", pred) \
             .withColumn(CONTRIB, contribs)


def vector_attribution(df: DataFrame, features: str, coefficients: Sequence[float], intercept: float,
                       names: Sequence[str]) -> DataFrame:
    """AT1 for a fitted Spark ML linear model over an assembled vector column."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer
    mean_vec = df.select(Summarizer.mean(F.col(features)).alias("m")).first()["m"].toArray()
    arr = vector_to_array(F.col(features))
    coef = [float(c) for c in coefficients]
    contribs = F.array(*[F.struct(F.lit(n).alias("feature"),
                                  (dlit(c) * (arr[i] - dlit(float(mu)))).alias("contribution"))
                         for i, (n, c, mu) in enumerate(zip(names, coef, mean_vec))])
    base = float(intercept) + sum(c * float(mu) for c, mu in zip(coef, mean_vec))
    return df.withColumn("base_value", dlit(base)).withColumn(CONTRIB, contribs)


def top_k(contribs: Column, k: int) -> Column:
    """O2: the k largest |contribution|s of a row (ties → feature name), no shuffle."""
    keyed = F.transform(contribs, lambda c: F.struct(
        (-F.abs(c["contribution"])).alias("k"), c["feature"].alias("feature"),
        c["contribution"].alias("contribution")))
    return F.transform(F.slice(F.sort_array(keyed), 1, k),
                       lambda s: F.struct(s["feature"].alias("feature"),
                                          s["contribution"].alias("contribution")))


def display_items(contribs: Column) -> Column:
    """P20: integer-rounded contribution (half-even) and direction label."""
    return F.transform(contribs, lambda c: F.struct(
        c["feature"].alias("feature"),
        F.bround(c["contribution"], 0).cast("int").alias("contribution"),
        F.when(c["contribution"] > 0, F.lit("positive")).otherwise(F.lit("negative")).alias("direction")))


def explanation(df: DataFrame, k: int = 5) -> DataFrame:
    """AT2: one struct per row — base, prediction, top-k and all contributions."""
    return df.withColumn("explanation", F.struct(
        F.col("base_value").alias("base_value"), F.col("prediction").alias("prediction"),
        top_k(F.col(CONTRIB), k).alias("top_features"), F.col(CONTRIB).alias("all_features")))


def global_importance(df: DataFrame) -> DataFrame:
    """AT3: mean |contribution| per feature."""
    return (df.select(F.explode(CONTRIB).alias("c"))
            .groupBy(F.col("c.feature").alias("feature"))
            .agg(F.avg(F.abs(F.col("c.contribution"))).alias("mean_abs_contribution")))


def top_features(importance: DataFrame, k: int) -> DataFrame:
    """O3: the k most important features (a top-k, ``TakeOrderedAndProject``)."""
    return importance.orderBy(F.desc("mean_abs_contribution"), "feature").limit(k)


# ------------------------------------------------------------------------ AT4
def permutation_shapley(model, rows: DataFrame, background: DataFrame, id_cols: Sequence[str],
                        features: Sequence[str], permutations: int = 8, seed: int = 42,
                        prediction: str = "prediction", max_background: int = 64) -> DataFrame:
    """Sampled permutation Shapley values for any fitted model as one Spark job.

    For every explained row, permutation π and background row b, the
    coalitions x_{π[:j]} ∪ b_{rest} (j = 0..d) are materialised by a
    ``posexplode`` of masks, scored by one ``model.transform`` and
    differenced along j with ``lag`` inside (row, π, b); the average over
    (π, b) estimates φ. Per permutation the differences telescope to
    f(x) − f(b), so Σφ = mean f(x) − mean_b f(b) holds exactly (efficiency).
    ``rows`` and ``background`` are the caller's bounded samples (S10).
    """
    import random

    from pyspark.sql.window import Window as W

    d = len(features)
    rng = random.Random(seed)
    perms = [rng.sample(range(d), d) for _ in range(permutations)]
    # masks[p][j] = set of features taken from x at step j of permutation p
    masks = []
    for pi, perm in enumerate(perms):
        for j in range(d + 1):
            taken = set(perm[:j])
            added = perm[j - 1] if j > 0 else -1
            masks.append((pi, j, added, [1 if f in taken else 0 for f in range(d)]))
    # background and masks are bounded by construction (≤ max_background rows,
    # (d+1)·permutations masks): both become literal arrays exploded per row,
    # so each task expands only its own rows and nothing is joined
    bg_rows = background.select(*features).limit(max_background + 1).collect()
    if len(bg_rows) > max_background:
        raise ValueError(f"background larger than {max_background} rows; sample it first")
    bg_lit = F.array(*[F.struct(F.lit(bi).alias("bid"),
                                *[F.lit(r[f]).alias(f"_b_{f}") for f in features])
                       for bi, r in enumerate(bg_rows)])
    mask_lit = F.array(*[F.struct(F.lit(pi).alias("perm"), F.lit(j).alias("step"),
                                  F.lit(added).alias("added"),
                                  F.array(*[F.lit(t) for t in take]).alias("take"))
                         for pi, j, added, take in masks])
    combo = (rows.select(*id_cols, *[F.col(f).alias(f"_x_{f}") for f in features])
             .withColumn("_bg", F.explode(bg_lit)).withColumn("_m", F.explode(mask_lit))
             .select("*", F.col("_bg.bid").alias("_bid"),
                     *[F.col(f"_bg._b_{f}").alias(f"_b_{f}") for f in features],
                     F.col("_m.perm").alias("perm"), F.col("_m.step").alias("step"),
                     F.col("_m.added").alias("added"), F.col("_m.take").alias("take"))
             .drop("_bg", "_m"))
    for i, f in enumerate(features):
        combo = combo.withColumn(f, F.when(F.element_at("take", i + 1) == 1, F.col(f"_x_{f}"))
                                 .otherwise(F.col(f"_b_{f}")))
    scored = model.transform(combo)
    w = W.partitionBy(*id_cols, "_bid", "perm").orderBy("step")
    diffs = scored.withColumn("delta", F.col(prediction) - F.lag(prediction).over(w)) \
                  .where(F.col("step") > 0)
    feat_name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("added") + 1)
    return (diffs.groupBy(*id_cols, feat_name.alias("feature"))
            .agg(F.avg("delta").alias("contribution")))
