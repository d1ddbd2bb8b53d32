"""Registered queries: a model published with all it needs, and the runs that read it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import rnd, round_doubles
from ..operators import artefacts as AF
from ..roles import CANDIDATE_ROLES, CATEGORICAL_FEATURES, NUMERICAL_FEATURES
from ..session import ensure_checkpoint_dir, written
from ..sources.tables import cand, with_cand
from .metrics_q import AGE_GROUP_SQL, with_age_group
from .registry import register

NUM, CAT = list(NUMERICAL_FEATURES), list(CATEGORICAL_FEATURES)
ALPHA, MISS, VERSION = 1.0, 0.1, "ridge-1"


def _published(spark, sf, *more):
    """(candidates with their split, artefacts): orders divisible by 5 calibrate, the next test, the rest train.

    The features, the label and ``more`` columns are written once: training, calibration and the run each scan them."""
    turn = F.pmod(F.col("l_orderkey"), F.lit(5))
    df = with_age_group(cand(spark, sf)).withColumn("split", F.when(turn == 0, "calibration").when(turn == 1, "test").otherwise("train"))
    df = written(df.select(*NUM, *CAT, "salary", "split", *more))
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/artefacts-{uuid.uuid4().hex}"
    return df, AF.train_and_publish(root, VERSION, df, CANDIDATE_ROLES, "salary", "split", ALPHA, MISS)


# The oracle solves the ridge equations by conjugate gradients in a recursive
# CTE over the whole design: standardised numbers (missing: training median)
# and one column a level, all centred, so the intercept is free of penalty.
_STATS = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUM)
_IMPUTED = ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM cand WHERE l_orderkey % 5 >= 2)) AS {c}" for c in NUM)
_FEATURES = " UNION ALL ".join([f"SELECT id, train, salary AS y, '{c}' AS name, ({c} - m_{c}) / s_{c} AS v FROM filled, moments" for c in NUM]
                               + [f"SELECT id, train, salary, '{c}=' || {c}, 1.0 FROM filled" for c in CAT])
FIT_CTES = (f"""filled AS (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, l_orderkey % 5 >= 2 AS train, l_orderkey % 5 AS turn, salary, gender, age,
                  {", ".join(f"{c} AS given_{c}" for c in NUM)}, {_IMPUTED}, {", ".join(CAT)} FROM cand)""",
            f"moments AS (SELECT {_STATS}, avg(salary) AS ybar, count(*) AS n FROM filled WHERE train)",
            f"feat AS ({_FEATURES})",
            """terms AS (SELECT name, row_number() OVER (ORDER BY name) AS i, sum(v) AS s, sum(v * y) AS xy FROM feat WHERE train GROUP BY name)""",
            """prods AS (SELECT a.name AS na, b.name AS nb, sum(a.v * b.v) AS g FROM feat a JOIN feat b USING (id) WHERE a.train AND b.train GROUP BY ALL)""",
            f"""cells AS (SELECT a.i, b.i AS j, coalesce(g, 0) - a.s * b.s / n + CASE WHEN a.i = b.i THEN {ALPHA} ELSE 0 END AS v
          FROM terms a CROSS JOIN terms b CROSS JOIN moments LEFT JOIN prods ON na = a.name AND nb = b.name)""",
            """mat AS (SELECT list(line ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS line FROM cells GROUP BY i))""",
            """rhs AS (SELECT list(xy - s * ybar ORDER BY i) AS b FROM terms, moments)""",
            """cg(k, x, r, p, rs, rs0) AS (
  SELECT 0, list_transform(b, lambda v: CAST(0 AS DOUBLE)), b, b, list_dot_product(b, b), list_dot_product(b, b) FROM rhs
  UNION ALL
  SELECT k + 1, x, r, list_transform(r, lambda v, i: v + list_dot_product(r, r) / rs * p[i]), list_dot_product(r, r), rs0
  FROM (SELECT k, rs, rs0, p, list_transform(x, lambda v, i: v + al * p[i]) AS x, list_transform(r, lambda v, i: v - al * ap[i]) AS r
        FROM (SELECT *, rs / list_dot_product(p, ap) AS al FROM (SELECT cg.*, list_transform(m, lambda line: list_dot_product(line, p)) AS ap
              FROM cg, mat WHERE k < 1000 AND rs > 1e-28 * rs0))))""",
            """weights AS (SELECT name, s, x[i] AS w FROM terms, (SELECT x FROM cg ORDER BY k DESC LIMIT 1))""",
            """base AS (SELECT max(ybar) - sum(w * s / n) AS b0 FROM weights, moments)""",
            """pred AS (SELECT f.*, p.predicted FROM filled f JOIN (SELECT id, max(b0) + sum(coalesce(w, 0) * v) AS predicted FROM feat LEFT JOIN weights USING (name), base GROUP BY id) p USING (id))""",
            f"""res AS (SELECT abs(salary - predicted) AS e FROM pred WHERE turn = 0),
qh AS (SELECT list(e ORDER BY e)[CAST(least(ceil((count(*) + 1) * (1 - {MISS})), count(*) - 1) AS BIGINT) + 1] AS q FROM res)""")


def _sql(body: str, *more: str) -> str:
    return with_cand(body, *FIT_CTES, *more).replace("WITH cand", "WITH RECURSIVE cand", 1)


@register("scoring_from_artefacts", _sql(f"""
SELECT l_orderkey, l_linenumber, {", ".join(f"given_{c} AS {c}" for c in NUM)}, {", ".join(CAT)}, round(predicted, 0) AS predicted,
       round(greatest(0.0, predicted - q), 0) AS min_salary, round(predicted + q, 0) AS max_salary,
       CAST({1 - MISS} AS DOUBLE) AS confidence, '{VERSION}' AS model_version
FROM pred, qh"""), ops=("M10", "P14", "A27"))
def scoring_from_artefacts(spark, sf):
    """Every candidate's eight features, prediction, interval and the version that made them."""
    df, artefacts = _published(spark, sf, "l_orderkey", "l_linenumber")
    scored = AF.score(df, artefacts)
    return scored.select("l_orderkey", "l_linenumber", *NUM, *CAT, *[rnd(c, 0).alias(c) for c in ("predicted", "min_salary", "max_salary")], "confidence", "model_version")


@register("evaluation_from_artefacts", _sql(f"""
SELECT attribute, "group", count(*) AS count, round(avg(predicted), 2) AS mean_predicted, round(avg(salary), 2) AS mean_actual, round(avg(abs(predicted - salary)), 2) AS mae,
       round(sqrt(avg((predicted - salary) * (predicted - salary))), 2) AS rmse, round(avg(predicted - salary), 2) AS bias,
       round(avg(CASE WHEN abs(predicted - salary) <= q THEN 1.0 ELSE 0.0 END), 2) AS coverage, '{VERSION}' AS model_version
FROM (SELECT 'overall' AS attribute, 'all' AS "group", * FROM pred UNION ALL SELECT 'gender', gender, * FROM pred
      UNION ALL SELECT 'age_group', CAST({AGE_GROUP_SQL} AS VARCHAR), * FROM pred) t, qh
WHERE turn = 1 AND "group" IS NOT NULL GROUP BY attribute, "group\""""), ops=("M13", "A28", "A29"))
def evaluation_from_artefacts(spark, sf):
    """Test rows: overall and every protected attribute."""
    df, artefacts = _published(spark, sf, "gender", "age_group")
    return round_doubles(AF.evaluate(df.where("split = 'test'"), artefacts, ["gender", "age_group"], "salary"), 2)


@register("drift_from_artefacts", _sql(f"""
SELECT feature, round(sum((a - e) * ln(a / e)), 4) AS psi,
       CASE WHEN sum((a - e) * ln(a / e)) >= 0.25 THEN 'high' WHEN sum((a - e) * ln(a / e)) >= 0.1 THEN 'moderate' ELSE 'low' END AS drift_level, '{VERSION}' AS model_version
FROM (SELECT coalesce(t.feature, u.feature) AS feature, coalesce(u.share, 0.0001) AS a, coalesce(t.share, 0.0001) AS e
      FROM (SELECT * FROM shares WHERE train) t FULL JOIN (SELECT * FROM shares WHERE NOT train) u ON t.feature = u.feature AND t.bin = u.bin)
GROUP BY feature""", f"""sides AS (SELECT * FROM pred WHERE turn >= 1)""",
    "cells2 AS (" + " UNION ALL ".join(
        [f"""SELECT train, '{c}' AS feature, CAST(CAST(greatest(least(floor((x - lo) * (CAST(10 AS DOUBLE) / (hi - lo))), 9), 0) AS BIGINT) AS VARCHAR) AS bin
FROM (SELECT train, CAST({e} AS DOUBLE) AS x, (SELECT min(CAST({e} AS DOUBLE)) FROM sides WHERE train) AS lo, (SELECT max(CAST({e} AS DOUBLE)) FROM sides WHERE train) AS hi FROM sides) WHERE x IS NOT NULL"""
         for c, e in [*((c, f"given_{c}") for c in NUM), ("predicted_salary", "predicted")]]
        + [f"SELECT train, '{c}', CAST({c} AS VARCHAR) FROM sides WHERE {c} IS NOT NULL" for c in CAT]) + ")",
    """shares AS (SELECT train, feature, bin, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY train, feature) AS share FROM cells2 GROUP BY train, feature, bin)"""),
    ops=("A20", "A21", "A26"))
def drift_from_artefacts(spark, sf):
    """Test rows against the histograms stored with the model."""
    df, artefacts = _published(spark, sf)
    return round_doubles(AF.drift_from(df.where("split = 'test'"), artefacts, CANDIDATE_ROLES))
