"""Registered queries: drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import drift as DR
from ..roles import CATEGORICAL_FEATURES, NUMERICAL_FEATURES
from ..session import written
from ..sources.sampling import int_key_hash, int_key_hash_sql, order_sample
from ..sources.tables import cand, table, with_cand
from .registry import register

CUTOFF = "1998-01-01"


def ref_cur(spark, sf, *columns):
    """(reference, current) with these columns of the candidate view, which is written once for all passes of a run."""
    c = written(cand(spark, sf).select("o_orderdate", *columns))
    is_ref = F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp_ntz")
    return c.where(is_ref), c.where(~is_ref)


def sided(spark, sf):
    """One scan of the candidate view with side 0 = reference, 1 = current."""
    c = cand(spark, sf)
    is_cur = F.col("o_orderdate") >= F.lit(CUTOFF).cast("timestamp_ntz")
    return c.withColumn("_side", is_cur.cast("int"))


def sided_numbers(spark, sf):
    """``sided`` with the numbers only, written once for operators that scan it more than once."""
    return written(sided(spark, sf).select("_side", *NUM))


NUM = list(NUMERICAL_FEATURES)
CAT = list(CATEGORICAL_FEATURES)

LONG_NUM_CTE = f"""lnum AS (
  UNPIVOT (SELECT CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}' THEN 0 ELSE 1 END AS side,
                  {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUM)} FROM cand)
  ON {", ".join(NUM)} INTO NAME feature VALUE x)"""

LONG_CAT_CTE = f"""lcat AS (
  UNPIVOT (SELECT CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}' THEN 0 ELSE 1 END AS side,
                  {", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in CAT)} FROM cand)
  ON {", ".join(CAT)} INTO NAME feature VALUE category)"""


def psi_num_sql(own: bool) -> str:
    key = "feature, side" if own else "feature"
    join = "USING (feature, side)" if own else "USING (feature)"
    return f"""
rng AS (SELECT {key}, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
               CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
        FROM lnum GROUP BY {key}),
cnt AS (SELECT feature, side, CAST(least(floor((x - lo) * (CAST(10 AS DOUBLE) / (hi - lo))), 9) AS INTEGER) AS bin,
               count(*) AS c
        FROM lnum JOIN rng {join} GROUP BY ALL),
sz AS (SELECT feature, side, count(*) AS n FROM lnum GROUP BY ALL),
grid AS (SELECT DISTINCT feature, CAST(b.range AS INTEGER) AS bin FROM sz, range(10) b),
sh AS (SELECT g.feature, g.bin,
              coalesce(e.c, 0) / es.n AS e0, coalesce(a.c, 0) / cs.n AS a0
       FROM grid g
       LEFT JOIN cnt e ON e.feature = g.feature AND e.bin = g.bin AND e.side = 0
       LEFT JOIN cnt a ON a.feature = g.feature AND a.bin = g.bin AND a.side = 1
       JOIN sz es ON es.feature = g.feature AND es.side = 0
       JOIN sz cs ON cs.feature = g.feature AND cs.side = 1),
psi AS (SELECT feature, sum((CASE WHEN a0 = 0 THEN 0.0001 ELSE a0 END - CASE WHEN e0 = 0 THEN 0.0001 ELSE e0 END)
                         * ln(CASE WHEN a0 = 0 THEN 0.0001 ELSE a0 END / CASE WHEN e0 = 0 THEN 0.0001 ELSE e0 END)) AS psi
        FROM sh GROUP BY feature)"""


KS_CTES = """kc AS (SELECT feature, x, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS r,
                       sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS c FROM lnum GROUP BY feature, x),
krun AS (SELECT feature,
                sum(r) OVER w / sum(r) OVER (PARTITION BY feature) AS fr,
                sum(c) OVER w / sum(c) OVER (PARTITION BY feature) AS fc,
                sum(r) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature) AS m
         FROM kc WINDOW w AS (PARTITION BY feature ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ks AS (SELECT feature, max(abs(fr - fc)) AS ks_statistic, CAST(max(n) AS BIGINT) AS n_ref,
              CAST(max(m) AS BIGINT) AS n_cur FROM krun GROUP BY feature)"""

PSI_CAT_CTES = """ccnt AS (SELECT feature, side, category, count(*) AS c FROM lcat GROUP BY ALL),
csz AS (SELECT feature, side, count(*) AS n FROM lcat GROUP BY ALL),
cp AS (SELECT feature, side, category, c / n AS prop FROM ccnt JOIN csz USING (feature, side)),
cj AS (SELECT coalesce(e.feature, a.feature) AS feature, coalesce(e.prop, 0.0001) AS e, coalesce(a.prop, 0.0001) AS a
       FROM (SELECT * FROM cp WHERE side = 0) e
       FULL OUTER JOIN (SELECT * FROM cp WHERE side = 1) a ON e.feature = a.feature AND e.category = a.category),
cpsi AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM cj GROUP BY feature)"""

CHI2_CTES = """cells AS (SELECT feature, CAST(side AS VARCHAR) AS "row", category AS col, count(*) AS o FROM lcat GROUP BY ALL),
rt AS (SELECT feature, "row", sum(o) AS rt FROM cells GROUP BY ALL),
ct AS (SELECT feature, col, sum(o) AS ct FROM cells GROUP BY ALL),
dims AS (SELECT feature, sum(o) AS "N", count(DISTINCT "row") AS nr, count(DISTINCT col) AS nc FROM cells GROUP BY feature),
full_t AS (SELECT rt.feature, rt.rt, ct.ct, coalesce(c.o, 0) AS o, d."N", d.nr, d.nc
           FROM rt JOIN ct USING (feature) LEFT JOIN cells c ON c.feature = rt.feature AND c."row" = rt."row" AND c.col = ct.col
           JOIN dims d ON d.feature = rt.feature),
chi AS (SELECT feature, sum(power(abs(o - rt * ct / "N") - CASE WHEN (nr - 1) * (nc - 1) = 1
                                 THEN least(0.5, abs(o - rt * ct / "N")) ELSE 0 END, 2) / (rt * ct / "N")) AS chi2_statistic,
               CAST(max((nr - 1) * (nc - 1)) AS BIGINT) AS dof
        FROM full_t GROUP BY feature)"""


@register("psi_numeric_shared", with_cand("SELECT feature, round(psi, 4) AS psi FROM psi",
                                          LONG_NUM_CTE, psi_num_sql(False)), ops=("A20",))
def psi_numeric_shared(spark, sf):
    return round_doubles(DR.psi_numeric(DR.long_numeric_sided(sided_numbers(spark, sf), "_side", NUM),
                                        edges="shared"))


@register("psi_numeric_own_edges", with_cand("SELECT feature, round(psi, 4) AS psi FROM psi",
                                             LONG_NUM_CTE, psi_num_sql(True)), ops=("A20",))
def psi_numeric_own_edges(spark, sf):
    return round_doubles(DR.psi_numeric(DR.long_numeric_sided(sided_numbers(spark, sf), "_side", NUM),
                                        edges="own"))


@register("psi_categorical", with_cand("SELECT feature, round(psi, 4) AS psi FROM cpsi",
                                       LONG_CAT_CTE, PSI_CAT_CTES), ops=("A21", "J4", "U1"))
def psi_categorical(spark, sf):
    return round_doubles(DR.psi_categorical(DR.long_categorical_sided(sided(spark, sf), "_side", CAT)))


@register("ks_statistic", with_cand("SELECT feature, round(ks_statistic, 4) AS ks_statistic, n_ref, n_cur FROM ks",
                                    LONG_NUM_CTE, KS_CTES), ops=("A22",))
def ks_statistic(spark, sf):
    return round_doubles(DR.ks_statistic(DR.long_numeric_sided(sided(spark, sf), "_side", NUM)))


@register("chi2_two_sample", with_cand("SELECT feature, round(chi2_statistic, 4) AS chi2_statistic, dof FROM chi",
                                       LONG_CAT_CTE, CHI2_CTES), ops=("A23",))
def chi2_two_sample(spark, sf):
    return round_doubles(DR.chi2_two_sample(DR.long_categorical_sided(sided(spark, sf), "_side", CAT)))


@register("chi2_paired_orders", """
WITH cells AS (
  SELECT 'priority~status' AS feature, a.o_orderpriority AS "row", b.o_orderstatus AS col, count(*) AS o
  FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey GROUP BY ALL),
rt AS (SELECT feature, "row", sum(o) AS rt FROM cells GROUP BY ALL),
ct AS (SELECT feature, col, sum(o) AS ct FROM cells GROUP BY ALL),
dims AS (SELECT feature, sum(o) AS "N", count(DISTINCT "row") AS nr, count(DISTINCT col) AS nc FROM cells GROUP BY feature),
full_t AS (SELECT rt.feature, rt.rt, ct.ct, coalesce(c.o, 0) AS o, d."N", d.nr, d.nc
           FROM rt JOIN ct USING (feature) LEFT JOIN cells c ON c.feature = rt.feature AND c."row" = rt."row" AND c.col = ct.col
           JOIN dims d ON d.feature = rt.feature)
SELECT feature, round(sum(power(abs(o - rt * ct / "N") - CASE WHEN (nr - 1) * (nc - 1) = 1
                         THEN least(0.5, abs(o - rt * ct / "N")) ELSE 0 END, 2) / (rt * ct / "N")), 4) AS chi2_statistic,
       CAST(max((nr - 1) * (nc - 1)) AS BIGINT) AS dof
FROM full_t GROUP BY feature""", ops=("A23", "J3", "U3"))
def chi2_paired_orders(spark, sf):
    o = table(spark, sf, "orders")
    a = o.select("o_orderkey", "o_orderpriority")
    b = o.select("o_orderkey", "o_orderstatus")
    aligned = a.join(b, "o_orderkey")  # row alignment on the key (J3)
    return round_doubles(DR.chi2_paired(aligned, "o_orderpriority", "o_orderstatus",
                                        feature="priority~status"))


@register("drift_report_stats", with_cand("""
SELECT feature, 'numerical' AS kind, round(psi, 4) AS psi, round(ks_statistic, 4) AS ks_statistic,
       NULL::DOUBLE AS chi2_statistic,
       CASE WHEN psi >= 0.25 THEN 'high' WHEN psi >= 0.1 THEN 'moderate' ELSE 'low' END AS drift_level,
       round(greatest(psi, ks_statistic), 4) AS drift_score
FROM psi JOIN ks USING (feature) WHERE n_ref >= 10 AND n_cur >= 10
UNION ALL
SELECT feature, 'categorical', round(psi, 4), NULL, round(chi2_statistic, 4),
       CASE WHEN psi >= 0.25 THEN 'high' WHEN psi >= 0.1 THEN 'moderate' ELSE 'low' END,
       round(psi, 4)
FROM cpsi JOIN chi USING (feature)""", LONG_NUM_CTE, LONG_CAT_CTE, psi_num_sql(False)[1:], KS_CTES,
    PSI_CAT_CTES, CHI2_CTES), ops=("A24",))
def drift_report_stats(spark, sf):
    t = DR.drift_stats_table(sided(spark, sf), "_side", NUM, CAT)
    return round_doubles(t.select(
        "feature", "kind", "psi", "ks_statistic", "chi2_statistic", "drift_level",
        F.when(F.col("kind") == "numerical", F.greatest("psi", "ks_statistic"))
         .otherwise(F.col("psi")).alias("drift_score")))


# p-values in SQL: the asymptotic Kolmogorov tail with Stephens' correction as
# a fixed alternating series, and the χ² upper tail as 1 - the lower regularised
# gamma series (terms via lgamma), while the operators integrate (``functions/tails.py``).
PVAL_CTES = """kl AS (SELECT *, (sqrt(CAST(n_ref * n_cur AS DOUBLE) / CAST(n_ref + n_cur AS DOUBLE)) + 0.12
                   + 0.11 / sqrt(CAST(n_ref * n_cur AS DOUBLE) / CAST(n_ref + n_cur AS DOUBLE))) * ks_statistic AS lam
            FROM ks WHERE n_ref > 0 AND n_cur > 0),
kp AS (SELECT feature, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2.0 * (
           SELECT sum(CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * lam * lam))
           FROM range(1, 200) t(k)))) END AS p_value FROM kl),
cpv AS (SELECT feature, CASE WHEN dof <= 0 THEN 'NaN'::DOUBLE WHEN chi2_statistic <= 0 THEN 1.0
           ELSE greatest(0.0, 1.0 - (
             SELECT sum(exp(-(chi2_statistic / 2.0) + (dof / 2.0 + k) * ln(chi2_statistic / 2.0)
                            - lgamma(dof / 2.0 + k + 1.0)))
             FROM range(0, CAST(chi2_statistic / 2.0 + 40.0 * sqrt(chi2_statistic / 2.0 + 1.0) + 200.0 AS BIGINT)) t(k)))
           END AS p_value FROM chi)"""


DRIFT_REPORT_SELECT = """
SELECT feature, kind, round(psi, 4) AS psi, round(ks_statistic, 4) AS ks_statistic, round(p_value, 4) AS p_value,
       round(chi2_statistic, 4) AS chi2_statistic,
       CASE WHEN psi >= 0.25 THEN 'high' WHEN psi >= 0.1 THEN 'moderate' ELSE 'low' END AS drift_level,
       p_value < 0.05 AS test_drift, (psi >= 0.1 OR p_value < 0.05) AS drifted, round(drift_score, 4) AS drift_score
FROM (
  SELECT feature, 'numerical' AS kind, psi, ks_statistic, kp.p_value, NULL::DOUBLE AS chi2_statistic,
         greatest(psi, ks_statistic) AS drift_score
  FROM psi JOIN ks USING (feature) JOIN kp USING (feature) WHERE n_ref >= 10 AND n_cur >= 10
  UNION ALL
  SELECT feature, 'categorical', psi, NULL, cpv.p_value, chi2_statistic, psi
  FROM cpsi JOIN chi USING (feature) JOIN cpv USING (feature)) t"""


@register("drift_report", with_cand(DRIFT_REPORT_SELECT, LONG_NUM_CTE, LONG_CAT_CTE,
                                    psi_num_sql(False)[1:], KS_CTES, PSI_CAT_CTES, CHI2_CTES, PVAL_CTES),
          ops=("A24",))
def drift_report(spark, sf):
    per, _summary = DR.drift_report(spark, None, None, NUM, CAT, sided=(sided(spark, sf), "_side"))
    return round_doubles(per)


@register("drift_summary", with_cand("""
SELECT round(avg(s), 4) AS overall_drift_score, count(*) AS n_features FROM (
  SELECT greatest(psi, ks_statistic) AS s FROM psi JOIN ks USING (feature)
  UNION ALL SELECT psi FROM cpsi) t""", LONG_NUM_CTE, LONG_CAT_CTE, psi_num_sql(False)[1:], KS_CTES,
    PSI_CAT_CTES), ops=("A24",))
def drift_summary(spark, sf):
    _per, summary = DR.drift_report(spark, None, None, NUM, CAT, sided=(sided(spark, sf), "_side"))
    return round_doubles(summary.select("overall_drift_score", "n_features"))


@register("prediction_drift", with_cand("""
SELECT round(p.psi, 4) AS psi, round(k.ks_statistic, 4) AS ks_statistic, k.n_ref, k.n_cur,
       round(m.ref_mean, 4) AS ref_mean, round(m.ref_std, 4) AS ref_std,
       round(m.cur_mean, 4) AS cur_mean, round(m.cur_std, 4) AS cur_std,
       round(m.cur_mean - m.ref_mean, 4) AS mean_shift
FROM psi p JOIN ks k USING (feature),
     (SELECT avg(predicted_salary) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS ref_mean,
             stddev_pop(predicted_salary) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS ref_std,
             avg(predicted_salary) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS cur_mean,
             stddev_pop(predicted_salary) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS cur_std
      FROM cand) m""",
    f"""lnum AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}' THEN 0 ELSE 1 END AS side,
                  'predicted_salary' AS feature, predicted_salary AS x FROM cand WHERE predicted_salary IS NOT NULL)""",
    psi_num_sql(False)[1:], KS_CTES), ops=("A25",))
def prediction_drift(spark, sf):
    r, c = ref_cur(spark, sf, "predicted_salary")
    return round_doubles(DR.prediction_drift(r, c, "predicted_salary").drop("ks_p_value", "drift_detected"))


PREDICTED_LONG = f"""lnum AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}' THEN 0 ELSE 1 END AS side,
                  'predicted_salary' AS feature, predicted_salary AS x FROM cand WHERE predicted_salary IS NOT NULL)"""


@register("prediction_drift_verdict", with_cand("""
SELECT round(psi, 4) AS psi, round(ks_statistic, 4) AS ks_statistic, round(p_value, 4) AS ks_p_value,
       (psi >= 0.1 OR p_value < 0.05) AS drift_detected, n_ref, n_cur
FROM psi JOIN ks USING (feature) JOIN kp USING (feature)""", PREDICTED_LONG, psi_num_sql(False)[1:], KS_CTES, PVAL_CTES.split("cpv AS")[0].rstrip().rstrip(",")),
    ops=("A25",))
def prediction_drift_verdict(spark, sf):
    r, c = ref_cur(spark, sf, "predicted_salary")
    return round_doubles(DR.prediction_drift(r, c, "predicted_salary").select("psi", "ks_statistic", "ks_p_value", "drift_detected", "n_ref", "n_cur"))


@register("drift_run", with_cand(f"""
SELECT round((SELECT avg(drift_score) FROM rep), 4) AS overall_drift_score,
       coalesce((SELECT max(CASE WHEN drifted THEN 1 ELSE 0 END) = 1 FROM rep), false) AS drift_detected,
       coalesce((SELECT list(feature ORDER BY feature) FROM rep WHERE drifted), []) AS drifted_features,
       (SELECT count(*) FROM rep) AS n_features,
       round(p.psi, 4) AS prediction_psi, round(p.ks_statistic, 4) AS prediction_ks_statistic,
       round(p.p_value, 4) AS prediction_ks_p_value, (p.psi >= 0.1 OR p.p_value < 0.05) AS prediction_drift_detected,
       (SELECT count(*) FROM cand WHERE o_orderdate < TIMESTAMP '{CUTOFF}') AS reference_size,
       (SELECT count(*) FROM cand WHERE o_orderdate >= TIMESTAMP '{CUTOFF}') AS current_size
FROM (SELECT * FROM psi JOIN ks USING (feature) JOIN kp USING (feature) WHERE feature = 'predicted_salary') p""",
    f"""lnum AS (
  UNPIVOT (SELECT CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}' THEN 0 ELSE 1 END AS side,
                  {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in [*NUM, "predicted_salary"])} FROM cand)
  ON {", ".join([*NUM, "predicted_salary"])} INTO NAME feature VALUE x)""", LONG_CAT_CTE,
    psi_num_sql(False)[1:], KS_CTES, PSI_CAT_CTES, CHI2_CTES, PVAL_CTES,
    "rep AS (SELECT * FROM (" + DRIFT_REPORT_SELECT + ") WHERE feature <> 'predicted_salary')"), ops=("A24", "A25", "A26"))
def drift_run(spark, sf):
    r, c = ref_cur(spark, sf, *NUM, *CAT, "predicted_salary")
    return round_doubles(DR.drift_run(r, c, NUM, CAT, "predicted_salary").drop("mean_shift"))


# The reference's default run samples the current table from the reference
# (1000 rows, seed 123). The sample is the 1000 smallest rows by a portable
# integer hash of the line key, ties broken by every column the report reads,
# so DuckDB draws the identical sample.
SAMPLE_KEY = ["l_orderkey", "l_linenumber"]
SAMPLE_TIE = ["l_orderkey", "l_linenumber", "salary", *NUM, *CAT]
SAMPLE_N, SAMPLE_SEED = 1000, 123
SAMPLED_CTES = (
    f"""smp AS (SELECT * FROM cand ORDER BY {int_key_hash_sql(SAMPLE_KEY, SAMPLE_SEED)},
           {", ".join(f"{c} NULLS FIRST" for c in SAMPLE_TIE)} LIMIT {SAMPLE_N})""",
    f"""lnum AS (
  UNPIVOT (SELECT 0 AS side, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUM)} FROM cand
           UNION ALL
           SELECT 1 AS side, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUM)} FROM smp)
  ON {", ".join(NUM)} INTO NAME feature VALUE x)""",
    f"""lcat AS (
  UNPIVOT (SELECT 0 AS side, {", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in CAT)} FROM cand
           UNION ALL
           SELECT 1 AS side, {", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in CAT)} FROM smp)
  ON {", ".join(CAT)} INTO NAME feature VALUE category)""")


@register("run_drift_sampled", with_cand(DRIFT_REPORT_SELECT, *SAMPLED_CTES, psi_num_sql(True)[1:], KS_CTES,
                                         PSI_CAT_CTES, CHI2_CTES, PVAL_CTES), ops=("A26", "S10"))
def run_drift_sampled(spark, sf):
    """The reference's default run: the current table is a fixed-size sample of
    the reference; PSI bins each side on its own range as the reference does."""
    c = cand(spark, sf)
    cur = order_sample(c, int_key_hash(SAMPLE_KEY, SAMPLE_SEED), SAMPLE_TIE, SAMPLE_N)
    per, _ = DR.drift_report(spark, c, cur, NUM, CAT, edges="own")
    return round_doubles(per)
