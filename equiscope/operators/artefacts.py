"""Versioned artefacts of a trained model, and the runs that read them.

A version is one model, its conformal q_hat, the reference histograms and its
test metrics, published together: the tables are written to a folder of their
own first, then a manifest that names them is moved to its final name. A reader
sees a whole version or none; a job that dies before the move leaves no version,
and a version once published is never overwritten. Scoring, evaluation and drift
runs read the manifest and its tables, never the training rows.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import dlit
from ..roles import PSI_EMPTY_SHARE, PSI_HIGH, PSI_MODERATE, FeatureRoles
from . import conformal, gram, quantile

MODEL_SCHEMA = "part string, column string, level string, weight double"
HISTOGRAM_SCHEMA = "feature string, kind string, bin string, lo double, hi double, share double"


def _files(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def publish(root: str, version: str, tables: dict[str, DataFrame], values: dict, spark: SparkSession) -> None:
    """Publish ``tables`` and ``values`` (numbers and strings, finite) as ``version`` (letters, digits, ``.``, ``-``, ``_``).

    Raises ``ValueError`` if the version exists. The file system's rename is
    what makes a version appear; it must be atomic, as HDFS's is.
    """
    if not version or not all(c.isalnum() or c in ".-_" for c in version) or version.startswith((".", "_")):
        raise ValueError(f"no name for a version: {version!r}")
    root = root.rstrip("/")
    fs, final = _files(spark, f"{root}/versions/{version}.json")
    if fs.exists(final):
        raise ValueError(f"version {version} is published already")
    data = f"data/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{data}/{name}")
    text = json.dumps({"version": version, "tables": {name: f"{data}/{name}" for name in tables}, "values": values}, allow_nan=False, sort_keys=True)
    _, draft = _files(spark, f"{root}/{data}/manifest.json")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.mkdirs(final.getParent())
    if fs.exists(final) or not fs.rename(draft, final):
        raise ValueError(f"version {version} was published meanwhile")


@dataclass(frozen=True)
class Artefacts:
    version: str
    tables: dict[str, DataFrame]
    values: dict


def versions(spark: SparkSession, root: str) -> list[str]:
    """Published versions, oldest first (by the manifest's time, then name)."""
    fs, folder = _files(spark, f"{root.rstrip('/')}/versions")
    if not fs.exists(folder):
        return []
    found = [(f.getModificationTime(), f.getPath().getName()) for f in fs.listStatus(folder)]
    return [name.removesuffix(".json") for _, name in sorted(found) if name.endswith(".json")]


def load(spark: SparkSession, root: str, version: str | None = None) -> Artefacts | None:
    """The named version, or the newest; None if there is none. A missing or damaged table of a version is an error."""
    root, known = root.rstrip("/"), versions(spark, root)
    if not known or (version is not None and version not in known):
        return None
    version = known[-1] if version is None else version
    manifest = json.loads(spark.read.text(f"{root}/versions/{version}.json", wholetext=True).first()[0])
    return Artefacts(version, {name: spark.read.parquet(f"{root}/{path}") for name, path in manifest["tables"].items()}, manifest["values"])


# ---------------------------------------------------------------------- model
def model_rows(fit: gram.LinearFit) -> list[tuple]:
    rows = [("intercept", None, None, fit.intercept)]
    for c, (slope, fill) in fit.numbers.items():
        rows += [("slope", c, None, slope), ("fill", c, None, fill)]
    for c, effects in fit.levels.items():
        rows += [("level", c, level, effect) for level, effect in effects.items()]
        rows.append(("mode", c, fit.modes[c], None))
    return rows


def model_from(table: DataFrame) -> gram.LinearFit:
    """One row a weight: as many as the model has features and levels."""
    rows = table.collect()
    of = lambda part: {r["column"]: r for r in rows if r["part"] == part}
    slopes, fills, modes = of("slope"), of("fill"), of("mode")
    levels = {c: {r["level"]: r["weight"] for r in rows if r["part"] == "level" and r["column"] == c} for c in modes}
    return gram.LinearFit(of("intercept")[None]["weight"], {c: (r["weight"], fills[c]["weight"]) for c, r in slopes.items()},
                          levels, {c: r["level"] for c, r in modes.items()})


def _binned(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin of [lo, hi]; values beyond fall in the end bins."""
    at = F.floor((x - lo) * F.try_divide(dlit(bins), hi - lo))
    return F.greatest(F.least(at, F.lit(bins - 1)), F.lit(0)).cast("string")


def _values(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    one = lambda c, x, s: F.struct(F.lit(c).alias("feature"), x.alias("x"), s.alias("s"))
    cells = [one(c, F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(None).cast("string")) for c in numeric]
    cells += [one(c, F.lit(None).cast("double"), F.col(c).cast("string")) for c in categorical]
    return df.select(F.explode(F.array(*cells)).alias("v")).select("v.*").where("x IS NOT NULL OR s IS NOT NULL")


def histograms(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], bins: int = 10) -> DataFrame:
    """Share of each occupied bin (numeric, equal width over the range) or category. NULL and NaN aren't counted."""
    ends = df.agg(*[f(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(f"{k}{i}") for i, c in enumerate(numeric) for k, f in (("lo", F.min), ("hi", F.max))]).first() if numeric else {}
    rows = []
    for i, c in enumerate(numeric):  # one row of range a feature
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        if lo is not None:
            rows.append((c, lo - 0.5 if lo == hi else lo, hi + 0.5 if lo == hi else hi))
    ranges = df.sparkSession.createDataFrame(rows, "feature string, lo double, hi double")
    values = _values(df, numeric, categorical).join(F.broadcast(ranges), "feature", "left")
    counts = (values.groupBy("feature", F.when(F.col("s").isNull(), "numerical").otherwise("categorical").alias("kind"),
                             F.coalesce("s", _binned(F.col("x"), F.col("lo"), F.col("hi"), bins)).alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("c")))
    total = counts.groupBy(F.col("feature").alias("_f")).agg(F.sum("c").alias("n"))  # one row a feature
    return counts.join(F.broadcast(total), F.col("feature") == F.col("_f")).select("feature", "kind", "bin", "lo", "hi", (F.col("c") / F.col("n")).alias("share"))


def train_and_publish(root: str, version: str, df: DataFrame, roles: FeatureRoles, label: str, split: str, alpha: float = 1.0,
                      miss: float = 0.1, bins: int = 10) -> Artefacts:
    """Fit a ridge model on the rows whose ``split`` is 'train', q_hat on 'calibration', metrics on 'test', histograms of 'train'; publish all.

    Rows without label take no part. Without training rows, or with too few
    calibration rows for ``miss``, ``ValueError``; without test rows the metrics are absent.
    """
    spark = df.sparkSession
    df = df.where(F.col(label).isNotNull())
    train = df.where(F.col(split) == "train").withColumn("_of", F.lit(0))
    grams = gram.fold_grams(train, roles, label, "_of")
    if not grams.folds:
        raise ValueError("no training rows")
    # of all numbers, also those complete in training: rows to be scored may lack them
    medians = {c: found[0] for (c, _), found in quantile.column_quantiles(train, roles.numerical, [0.5]).items()}
    fit = gram.fit_gram(grams.names, grams.of_training(None), alpha, {c: float(m) for c, m in medians.items() if m is not None})
    scored = df.withColumn("_p", fit.column())
    q_hat, n = conformal.conformal_quantile(scored.where(F.col(split) == "calibration"), label, "_p", miss)
    off = F.col("_p") - F.col(label)
    test = scored.where(F.col(split) == "test").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse")).first()
    metrics = {k: test[k] for k in ("mae", "rmse") if test[k] is not None and math.isfinite(test[k])}
    tables = {"model": spark.createDataFrame(model_rows(fit), MODEL_SCHEMA).coalesce(1),
              "histograms": histograms(scored.where(F.col(split) == "train").withColumn(roles.prediction, F.col("_p")),
                                       [*roles.numerical, roles.prediction], roles.categorical, bins)}
    publish(root, version, tables, {"q_hat": q_hat, "calibration_size": n, "confidence": 1.0 - miss, "test_size": test["n"], "bins": bins, **metrics}, spark)
    return load(spark, root, version)


# ----------------------------------------------------------------------- runs
def score(df: DataFrame, artefacts: Artefacts) -> DataFrame:
    """The rows with ``predicted``, ``min_salary``, ``max_salary`` (± q_hat, not below 0), ``confidence`` and ``model_version``.

    Columns of those names give way. Missing numbers take the training median,
    a NULL category the training mode; an unseen level counts nothing.
    """
    fit, q = model_from(artefacts.tables["model"]), dlit(artefacts.values["q_hat"])
    return df.withColumn("predicted", fit.column()).withColumns({"min_salary": F.greatest(dlit(0.0), F.col("predicted") - q), "max_salary": F.col("predicted") + q,
                            "confidence": dlit(artefacts.values["confidence"]), "model_version": F.lit(artefacts.version)})


def evaluate(df: DataFrame, artefacts: Artefacts, attrs: Sequence[str], label: str) -> DataFrame:
    """Errors and interval coverage overall (``attribute`` 'overall') and per group of every attribute, in one grouped pass. Rows without label take no part; NULL groups are left out."""
    scored = score(df.where(F.col(label).isNotNull()), artefacts)
    at = [F.struct(F.lit("overall").alias("attribute"), F.lit("all").alias("group"))]
    at += [F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("group")) for a in attrs]
    off, q = F.col("predicted") - F.col("_y"), dlit(artefacts.values["q_hat"])
    long = scored.select(F.col(label).cast("double").alias("_y"), "predicted", F.explode(F.array(*at)).alias("_at")).select("_y", "predicted", "_at.*")
    return (long.where(F.col("group").isNotNull()).groupBy("attribute", "group")
            .agg(F.count(F.lit(1)).alias("count"), F.avg("predicted").alias("mean_predicted"), F.avg("_y").alias("mean_actual"), F.avg(F.abs(off)).alias("mae"),
                 F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(off).alias("bias"), F.avg((F.abs(off) <= q).cast("double")).alias("coverage"))
            .withColumn("model_version", F.lit(artefacts.version)))


def drift_from(df: DataFrame, artefacts: Artefacts, roles: FeatureRoles) -> DataFrame:
    """PSI of every feature and of the predictions of ``df`` against the stored histograms, with level and ``model_version``.

    Values beyond the stored range count in the end bins, empty bins as 0.0001;
    a feature that one side lacks wholly has no row.
    """
    current = score(df, artefacts).withColumn(roles.prediction, F.col("predicted"))
    stored = artefacts.tables["histograms"]
    ranges = stored.where("kind = 'numerical'").select("feature", "lo", "hi").distinct()  # one row a feature
    values = _values(current, [*roles.numerical, roles.prediction], roles.categorical).join(F.broadcast(ranges), "feature", "left")
    counts = (values.groupBy("feature", F.coalesce("s", _binned(F.col("x"), F.col("lo"), F.col("hi"), artefacts.values["bins"])).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
              .where(F.col("bin").isNotNull()))
    total = counts.groupBy(F.col("feature").alias("_f")).agg(F.sum("c").alias("n"))
    now = counts.join(F.broadcast(total), F.col("feature") == F.col("_f")).select("feature", "bin", (F.col("c") / F.col("n")).alias("now"))
    both = stored.select("feature", "bin", F.col("share").alias("then")).join(now, ["feature", "bin"], "full")
    a, e = F.coalesce("now", dlit(PSI_EMPTY_SHARE)), F.coalesce("then", dlit(PSI_EMPTY_SHARE))
    psi = F.col("psi")
    return (both.groupBy("feature").agg(F.sum((a - e) * F.log(a / e)).alias("psi"), F.count("then").alias("_a"), F.count("now").alias("_b")).where("_a > 0 AND _b > 0")
            .select("feature", "psi", F.when(psi >= dlit(PSI_HIGH), "high").when(psi >= dlit(PSI_MODERATE), "moderate").otherwise("low").alias("drift_level"),
                    F.lit(artefacts.version).alias("model_version")))
