"""Cross-validated linear models from one Gram matrix per fold (M3, M4, M7-M9).

A linear model with its preprocessor (median imputation, standardised numbers,
one-hot levels) is a function of sums of products. One scan collects them per
fold over a raw design that needs no fitting: a constant, each number (0 where
missing) and its missing flag, and a flag per level (NULL is one of them).
Training sums are the total less the held-out fold, so the preprocessor is
fitted inside every fold, and any number of penalties costs small solves only.
A second scan measures the absolute errors of all folds and penalties at once.

Tasks keep one matrix per fold and send its non-zero entries by name, so levels
needn't be known before; Spark adds them up. Medians are needed only for numbers
that are missing somewhere, and come from the exact distributed quantiles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..roles import FeatureRoles
from . import quantile

ONE, LABEL = ("one", "", ""), ("label", "", "")


def _design(batch: pd.DataFrame, roles: FeatureRoles) -> tuple[list[tuple], np.ndarray]:
    """Names and columns of the raw design of a batch."""
    names, columns = [ONE], [np.ones(len(batch))]
    for c in roles.numerical:
        x = batch[c].to_numpy(dtype=float, na_value=np.nan)
        missing = np.isnan(x)
        names += [("number", c, ""), ("missing", c, "")]
        columns += [np.where(missing, 0.0, x), missing.astype(float)]
    for c in roles.categorical:
        codes, levels = pd.factorize(batch[c])
        for i, level in enumerate(levels):
            names.append(("level", c, str(level)))
            columns.append((codes == i).astype(float))
        names.append(("null", c, ""))
        columns.append((codes < 0).astype(float))
    return names, np.stack(columns, 1)


def _narrow(df: DataFrame, roles: FeatureRoles, label: str, fold: str) -> DataFrame:
    return df.select(F.col(fold).cast("int").alias("_fold"), F.col(label).cast("double").alias("_label"), *[F.col(c).cast("double").alias(c) for c in roles.numerical],
                     *[F.col(c).cast("string").alias(c) for c in roles.categorical]).where("_label IS NOT NULL AND _fold IS NOT NULL")


@dataclass(frozen=True)
class FoldGrams:
    """Sums of products of the raw design's columns (and the label) per fold."""

    names: list[tuple]
    folds: dict[int, np.ndarray]

    def of_training(self, held_out: int | None) -> np.ndarray:
        return sum((g for f, g in self.folds.items() if f != held_out), np.zeros((len(self.names),) * 2))


def fold_grams(df: DataFrame, roles: FeatureRoles, label: str, fold: str) -> FoldGrams:
    """One scan. Rows without label or fold take no part; NaN counts as missing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, dict] = {}
        for batch in batches:
            names, x = _design(batch, roles)
            names, x = [*names, LABEL], np.c_[x, batch["_label"].to_numpy(float)]
            for f in batch["_fold"].unique():
                mine = x[(batch["_fold"] == f).to_numpy()]
                g = mine.T @ mine
                sums = held.setdefault(int(f), {})
                for i, j in zip(*np.nonzero(np.triu(g))):
                    at = tuple(sorted((names[i], names[j])))
                    sums[at] = sums.get(at, 0.0) + g[i, j]
        for f, sums in held.items():
            yield pd.DataFrame([(f, *a, *b, v) for (a, b), v in sums.items()], columns=["f", "ak", "ac", "av", "bk", "bc", "bv", "v"])

    keys = ["f", "ak", "ac", "av", "bk", "bc", "bv"]
    schema = "f int, ak string, ac string, av string, bk string, bc string, bv string, v double"
    rows = _narrow(df, roles, label, fold).mapInPandas(run, schema).groupBy(*keys).agg(F.sum("v").alias("v")).collect()
    parts = [(r["f"], (r["ak"], r["ac"], r["av"]), (r["bk"], r["bc"], r["bv"]), r["v"]) for r in rows]
    always = {ONE, LABEL, *[(k, c, "") for c in roles.numerical for k in ("number", "missing")], *[("null", c, "") for c in roles.categorical]}
    names = sorted(always.union(*[{a, b} for _, a, b, _ in parts]))
    at = {name: i for i, name in enumerate(names)}
    folds: dict[int, np.ndarray] = {}
    for f, a, b, v in parts:
        g = folds.setdefault(f, np.zeros((len(names),) * 2))
        g[at[a], at[b]] = g[at[b], at[a]] = v
    return FoldGrams(names, dict(sorted(folds.items())))


@dataclass(frozen=True)
class LinearFit:
    """A fitted model over raw columns: numbers with their fill, levels with the level that stands for NULL."""

    intercept: float
    numbers: dict[str, tuple[float, float]]
    levels: dict[str, dict[str, float]]
    modes: dict[str, str | None]

    def column(self) -> Column:
        """The prediction as a JVM expression; unseen levels count nothing."""
        out = F.lit(float(self.intercept))
        for c, (slope, fill) in self.numbers.items():
            x = F.col(c).cast("double")
            out = out + F.lit(float(slope)) * F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(float(fill)))
        for c, effects in self.levels.items():
            if effects:
                table = F.create_map(*[F.lit(v) for level, effect in effects.items() for v in (level, float(effect))])
                out = out + F.coalesce(F.try_element_at(table, F.coalesce(F.col(c).cast("string"), F.lit(self.modes[c]))), F.lit(0.0))
        return out

    def weights(self, names: list[tuple]) -> np.ndarray:
        """The same as weights of raw design columns."""
        of = {ONE: self.intercept}
        for c, (slope, fill) in self.numbers.items():
            of["number", c, ""], of["missing", c, ""] = slope, slope * fill
        for c, effects in self.levels.items():
            of.update({("level", c, level): effect for level, effect in effects.items()})
            of["null", c, ""] = effects.get(self.modes[c], 0.0)
        return np.array([of.get(name, 0.0) for name in names])


def fit_gram(names: list[tuple], g: np.ndarray, alpha: float, medians: dict[str, float], scale: bool = True) -> LinearFit:
    """Least squares (``alpha`` 0: of least norm where levels are collinear) or ridge on standardised numbers and one-hot levels, intercept unpenalised (``scale`` false: numbers as they are)."""
    at = {name: i for i, name in enumerate(names)}
    n = g[at[ONE], at[ONE]]
    if not n:
        raise ValueError("no training rows")
    columns, spans, modes = [], [], {}

    def combined(parts: dict[tuple, float]) -> np.ndarray:
        out = np.zeros(len(names))
        for name, weight in parts.items():
            out[at[name]] = weight
        return out

    for kind, c, _ in names:
        if kind == "number":
            filled = combined({("number", c, ""): 1.0, ("missing", c, ""): medians.get(c, 0.0)})
            mean = filled @ g[:, at[ONE]] / n
            centred = filled - combined({ONE: mean})
            std = (float(np.sqrt(max(centred @ g @ centred / n, 0.0))) or 1.0) if scale else 1.0
            columns.append(centred / std)
            spans.append((c, mean, std))
    levels = [name for name in names if name[0] == "level" and g[at[name], at[name]] > 0]
    for c in dict.fromkeys(c for kind, c, _ in names if kind == "null"):
        mine = [name for name in levels if name[1] == c]
        modes[c] = min(mine, key=lambda name: (-g[at[name], at[name]], name[2]))[2] if mine else None
    for name in levels:
        columns.append(combined({name: 1.0, **({("null", name[1], ""): 1.0} if modes[name[1]] == name[2] else {})}))
    design = np.stack(columns, 1) if columns else np.zeros((len(names), 0))
    gram, sums, y = design.T @ g @ design, design.T @ g[:, at[ONE]], design.T @ g[:, at[LABEL]]
    mean_y = g[at[LABEL], at[ONE]] / n
    gram, y = gram - np.outer(sums, sums) / n, y - sums * mean_y
    w = np.linalg.lstsq(gram + alpha * np.eye(len(gram)), y, rcond=1e-11)[0] if len(gram) else np.zeros(0)
    numbers = {c: (w[i] / std, medians.get(c, 0.0)) for i, (c, _, std) in enumerate(spans)}
    effects: dict[str, dict[str, float]] = {c: {} for c in modes}
    for name, effect in zip(levels, w[len(spans):]):
        effects[name[1]][name[2]] = float(effect)
    intercept = mean_y - sums @ w / n - sum(w[i] * mean / std for i, (_, mean, std) in enumerate(spans))
    return LinearFit(float(intercept), {c: (float(s), float(m)) for c, (s, m) in numbers.items()}, effects, modes)


def training_medians(df: DataFrame, roles: FeatureRoles, grams: FoldGrams, label: str, fold: str) -> dict[int | None, dict[str, float]]:
    """Exact medians of each training set (total less a fold; None: all) of the numbers that are missing somewhere."""
    at = {name: i for i, name in enumerate(grams.names)}
    total = grams.of_training(None)
    gaps = [c for c in roles.numerical if total[at["missing", c, ""], at["missing", c, ""]] > 0]
    sets = (None, *grams.folds)
    if not gaps:
        return {held: {} for held in sets}
    found = quantile.column_quantiles(_narrow(df, roles, label, fold), gaps, [0.5], "_fold")
    return {held: {c: found[c, held][0] or 0.0 for c in gaps} for held in sets}


def fold_fits(df: DataFrame, roles: FeatureRoles, label: str, fold: str, alphas: Sequence[float]) -> tuple[FoldGrams, dict]:
    """The Gram matrices and the fits by (alpha, held-out fold; None: all rows); no fits of a single fold, or none."""
    grams = fold_grams(df, roles, label, fold)
    if len(grams.folds) < 2:
        return grams, {}
    medians = training_medians(df, roles, grams, label, fold)
    return grams, {(a, held): fit_gram(grams.names, grams.of_training(held), a, medians[held]) for a in alphas for held in (None, *grams.folds)}


def cross_validate(df: DataFrame, roles: FeatureRoles, label: str, fold: str, alphas: Sequence[float]) -> tuple[DataFrame, dict]:
    """(``alpha``, ``cv_mae``, ``cv_mae_std``) over the folds, and the fits by (alpha, held-out fold; None: all rows).

    Two scans besides the medians' passes, whatever the folds and penalties. A
    single fold, or none, gives no row.
    """
    spark, (grams, fits) = df.sparkSession, fold_fits(df, roles, label, fold, alphas)
    result = "alpha double, cv_mae double, cv_mae_std double"
    if not fits:
        return spark.createDataFrame([], result), {}
    weights = {f: np.stack([fits[a, f].weights(grams.names) for a in alphas], 1) for f in grams.folds}
    at = {name: i for i, name in enumerate(grams.names)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for batch in batches:
            names, x = _design(batch, roles)
            known = [at.get(name) for name in names]
            use = [i for i, k in enumerate(known) if k is not None]
            for f in batch["_fold"].unique():
                mine = (batch["_fold"] == f).to_numpy()
                off = np.abs(x[mine][:, use] @ weights[int(f)][[known[i] for i in use]] - batch["_label"].to_numpy(float)[mine, None])
                h = held.setdefault(int(f), [0, 0.0])
                h[0], h[1] = h[0] + len(off), h[1] + off.sum(0)
        for f, (n, off) in held.items():
            yield pd.DataFrame({"f": f, "a": np.arange(len(off)), "n": n, "off": off})

    errors = (_narrow(df, roles, label, fold).mapInPandas(run, "f int, a int, n long, off double")
              .groupBy("f", "a").agg((F.sum("off") / F.sum("n")).alias("mae")).groupBy("a").agg(F.avg("mae").alias("cv_mae"), F.stddev_pop("mae").alias("cv_mae_std")))
    rows = [(float(alphas[r["a"]]), r["cv_mae"], r["cv_mae_std"]) for r in errors.orderBy("a").collect()]
    return spark.createDataFrame(rows, result), fits


def out_of_fold(df: DataFrame, models: dict[str, dict[int, LinearFit]], fold: str) -> DataFrame:
    """``df`` with ``p_<model>``: each row's prediction by the fit that didn't see its fold (NULL for a fold without a fit)."""
    out = []
    for name, fits in models.items():
        expr = F.lit(None).cast("double")
        for held, fit in fits.items():
            expr = F.when(F.col(fold) == held, fit.column()).otherwise(expr)
        out.append(expr.alias(f"p_{name}"))
    return df.select("*", *out)
