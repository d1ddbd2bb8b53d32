"""Tails as column expressions against closed forms, and the verdicts that use them."""

import math

import pytest
from pyspark.sql import functions as F

from equiscope.functions import stats, tails
from equiscope.operators import drift, fairness


def _evaluated(spark, rows, names, expression):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} double" for n in names))
    return [r["p"] for r in df.withColumn("p", expression(*[F.col(n) for n in names])).orderBy("i").collect()]


def test_chi2_tail_closed_forms(spark):
    xs = [1e-9, 0.3, 1.0, 1.99, 2.01, 9.0, 60.0, 700.0]
    rows = [(x, d) for x in xs for d in (1.0, 2.0, 4.0, 6.0)]
    want = []
    for x, d in rows:
        h = x / 2
        want.append(math.erfc(math.sqrt(h)) if d == 1 else math.exp(-h) * sum(h ** j / math.factorial(j) for j in range(int(d) // 2)))
    assert _evaluated(spark, rows, ["x", "d"], tails.chi2_tail) == pytest.approx(want, rel=1e-11, abs=1e-300)
    assert [stats.chi2_sf(*r) for r in rows] == pytest.approx(want, rel=1e-11, abs=1e-300)


def test_f_tail_closed_forms(spark):
    rows, want = [], []
    for f in (1e-6, 0.2, 1.0, 1.7, 5.0, 300.0):
        rows.append((f, 1.0, 1.0))
        want.append(1 - 2 / math.pi * math.atan(math.sqrt(f)) if f < 1e3 else None)
        for n in (1.0, 10.0, 6e4, 1e7):  # I_x(n / 2, b) for whole b is a finite sum
            for b in (1, 2, 3):
                q = 2 * b * f / (n + 2 * b * f)
                rows.append((f, 2.0 * b, n))
                want.append(math.exp(n / 2 * math.log1p(-q)) * sum(math.prod((n / 2 + i) / (i + 1) for i in range(j)) * q ** j for j in range(b)))
    assert _evaluated(spark, rows, ["f", "a", "b"], tails.f_tail) == pytest.approx(want, rel=1e-8, abs=1e-290)


def test_tails_have_no_switch_of_size():
    for n in (1e3, 1e5, 1e7, 1e9, 1e12):  # the normal limit with its first correction
        assert stats.chi2_sf(n, n) == pytest.approx(0.5 - 2 / (3 * math.sqrt(4 * math.pi * n)), abs=1e-3 / math.sqrt(n) + 1e-9)
    assert abs(stats.kolmogorov_sf(1 - 1e-12) - stats.kolmogorov_sf(1.0)) < 1e-11
    assert stats.kolmogorov_sf(1.3580986393225505) == pytest.approx(0.05, abs=1e-12)


def test_tails_at_the_ends(spark):
    nan, inf = math.nan, math.inf
    got = _evaluated(spark, [(None, 1.0), (nan, 1.0), (1.0, 0.0), (0.0, 3.0), (-1.0, 3.0), (inf, 3.0)], ["x", "d"], tails.chi2_tail)
    assert got[0] is None and math.isnan(got[1]) and math.isnan(got[2]) and got[3:] == [1.0, 1.0, 0.0]
    got = _evaluated(spark, [(None, 1.0, 1.0), (nan, 1.0, 1.0), (1.0, 0.0, 1.0), (0.0, 2.0, 3.0), (inf, 2.0, 3.0)], ["f", "a", "b"], tails.f_tail)
    assert got[0] is None and math.isnan(got[1]) and math.isnan(got[2]) and got[3:] == [1.0, 0.0]
    got = _evaluated(spark, [(0.2, 0.0, 5.0), (None, 4.0, 5.0), (0.0, 4.0, 5.0), (1.0, 1e6, 1e6)], ["d", "n", "m"], tails.ks_tail)
    assert math.isnan(got[0]) and got[1] is None and got[2:] == [1.0, 0.0]


def test_proxy_table_against_pairs(spark):
    rows = [("a", "x", 1, 1.0, 7.0), ("a", "y", 2, 2.0, 7.0), ("b", "x", 3, 2.5, 7.0), ("b", None, 4, 4.5, 7.0), ("b", "y", None, 5.0, None), (None, "x", 6, 5.5, 7.0)]
    df = spark.createDataFrame(rows, "g string, h string, age int, x double, same double")
    got = {(r["protected"], r["feature"]): r for r in fairness.proxy_table(df, ["g", "h"], ["age"], ["x", "same"]).collect()}
    assert set(got) == {("g", "x"), ("h", "x"), ("age", "x")}  # no statistic of a constant
    for attr in "gh":
        old = {r["feature"]: r for r in fairness.anova_by_group(df, attr, ["x"]).collect()}["x"]
        new = got[attr, "x"]
        assert (new["groups"], new["n"]) == (old["k"], old["N"]) and new["statistic"] == pytest.approx(old["f_statistic"], rel=1e-12)
        assert new["p_value"] == pytest.approx(stats.f_sf(new["statistic"], new["groups"] - 1, new["n"] - new["groups"]), rel=1e-9)
        assert new["is_proxy"] == (new["p_value"] < 0.05)
    r = {x["feature"]: x["correlation"] for x in fairness.pearson_proxies(df, "age", ["x"]).collect()}["x"]
    assert got["age", "x"]["statistic"] == pytest.approx(r, rel=1e-12) and got["age", "x"]["n"] == 5 and got["age", "x"]["is_proxy"]
    assert [x["feature"] for x in fairness.pearson_proxies(df, "age", ["x", "same"]).collect()] == ["x"]  # a constant has no r
    assert fairness.proxy_table(df.where("false"), ["g"], ["age"], ["x"]).count() == 0
    apart = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, x double")
    row = fairness.proxy_table(apart, ["g"], [], ["x"]).first()
    assert row["statistic"] == math.inf and row["p_value"] == 0.0 and row["is_proxy"]


def test_status_and_audit_verdict(spark):
    rows = [("warn", 0.2, 0.0, 0.0), ("money", 0.0, 0.0, 60000.0), ("review", -0.07, 0.0, 0.0), ("review2", 0.0, 0.0, 30000.0), ("odds", 0.0, 0.06, 0.0),
            ("edge", 0.05, 0.05, 20000.0), ("none", None, None, None)]
    disp = spark.createDataFrame(rows, "attribute string, dp_difference double, eo_difference double, mean_prediction_difference double")
    status = {r["attribute"]: r for r in fairness.fairness_status(disp).collect()}
    assert {a: r["status"] for a, r in status.items()} == {"warn": "WARNING", "money": "WARNING", "review": "REVIEW", "review2": "REVIEW", "odds": "PASS", "edge": "PASS", "none": "PASS"}
    assert [len(status[a]["recommendations"]) for a in ("warn", "money", "review", "edge")] == [2, 1, 1, 0]
    audit = {r["attribute"]: (r["gaps_detected"], len(r["recommendations"])) for r in fairness.audit_verdict(disp).collect()}
    assert {a for a, (gap, n) in audit.items() if gap and n == 4} == {"warn", "review", "odds"}
    assert all(n == 0 for gap, n in audit.values() if not gap)


def test_drift_run_flags(spark):
    ref = spark.createDataFrame([(float(i % 50), "ab"[i % 2], float(i)) for i in range(400)], "x double, c string, p double")
    same, moved = drift.drift_run(ref, ref, ["x"], ["c"], "p").first(), drift.drift_run(ref, ref.selectExpr("x + 30 AS x", "'a' AS c", "p + 200 AS p"), ["x"], ["c"], "p").first()
    assert not same["drift_detected"] and not same["prediction_drift_detected"] and same["drifted_features"] == [] and same["prediction_ks_p_value"] == 1.0
    assert moved["drift_detected"] and moved["prediction_drift_detected"] and moved["drifted_features"] == ["c", "x"]
    assert (moved["reference_size"], moved["current_size"], moved["mean_shift"]) == (400, 400, 200.0)


def test_report_lines(spark):
    disp = spark.createDataFrame([("b", 0.2, 0.0, 1234.567), ("a", 0.01, 0.0, None)], "attribute string, dp_difference double, eo_difference double, mean_prediction_difference double")
    rates = spark.createDataFrame([("b", 'say "x"', 3, 10.5, None, 0.0, 2.0, -0.5), ("a", "y", 1, 9.4, 8.5, 1.005, None, 0.4)],
                                  "attribute string, group string, count long, mean_predicted double, mean_actual double, mae double, rmse double, bias double")
    lines = [tuple(r) for r in fairness.report_lines(fairness.fairness_status(disp), rates).orderBy("section", "position").collect()]
    assert lines == [
        ("1 status", 1, "Overall Status,REVIEW"),
        ("2 attributes", 1, 'a,PASS,0.0100,0.00,"None"'),
        ("2 attributes", 2, 'b,WARNING,0.2000,1234.57,"Review b fairness: DP difference = 0.200; Consider post-processing calibration for b"'),
        ("3 groups", 1, 'a,"y",1,9,9,1.01,N/A,0'),
        ("3 groups", 2, 'b,"say ""x""",3,11,N/A,N/A,2.00,0'),
        ("4 recommendations", 1, '1,"Review b fairness: DP difference = 0.200"'),
        ("4 recommendations", 2, '2,"Consider post-processing calibration for b"')]
    empty = fairness.report_lines(fairness.fairness_status(disp.where("false")), rates.where("false")).collect()
    assert [tuple(r) for r in empty] == [("1 status", 1, "Overall Status,UNKNOWN")]
