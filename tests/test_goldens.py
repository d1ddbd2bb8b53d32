"""Hand-computed goldens, edge cases (T-list) and identities on tiny frames."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from equiscope.functions import stats
from equiscope.functions.columns import cut, log1p_guarded, safe_div
from equiscope.operators import conformal as CF
from equiscope.operators import drift as DR
from equiscope.operators import fairness as FA
from equiscope.operators import metrics as M
from equiscope.operators import quantile as Q
from equiscope.operators import similar as SIM
from equiscope.roles import (AGE_GROUP_EDGES, AGE_GROUP_LABELS, EXP_BUCKET_EDGES,
                             EXP_BUCKET_LABELS, FeatureRoles)


def test_cut_is_right_closed(spark):
    df = spark.createDataFrame([(x,) for x in [-1.0, -0.5, 0.0, 0.1, 2.0, 2.5, 30.0, 30.1]], "x double")
    got = [r[0] for r in df.select(cut("x", EXP_BUCKET_EDGES, EXP_BUCKET_LABELS)).collect()]
    assert got == [None, "0", "0", "0-2", "0-2", "2-5", "15+", None]
    ages = spark.createDataFrame([(a,) for a in [20, 21, 30, 65, 66]], "a int")
    got = [r[0] for r in ages.select(cut("a", AGE_GROUP_EDGES, AGE_GROUP_LABELS)).collect()]
    assert got == [None, "20-30", "20-30", "50+", None]


def test_log1p_guard_and_safe_div(spark):
    df = spark.createDataFrame([(-1.0, 0.0), (0.0, 2.0)], "x double, d double")
    r = df.select(log1p_guarded("x").alias("l"), safe_div(F.lit(1.0), F.col("d")).alias("q")).collect()
    assert r[0]["l"] is None and r[0]["q"] is None
    assert r[1]["l"] == 0.0 and r[1]["q"] == 0.5


def test_bround_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (1500.0,), (2500.0,)], "x double")
    got = [r[0] for r in df.select(F.bround("x", 0)).collect()]
    assert got == [0.0, 2.0, 2.0, 1500.0, 2500.0]
    got = [r[0] for r in df.select(F.bround("x", -3)).collect()]
    assert got[3:] == [2000.0, 2000.0]


def test_regression_metrics_goldens(spark):
    perfect = spark.createDataFrame([(100e3, 100e3), (120e3, 120e3), (140e3, 140e3)], "y double, p double")
    r = M.regression_metrics(perfect, "y", "p").first()
    assert r["mae"] == 0 and r["rmse"] == 0 and r["r2"] == 1.0
    const = spark.createDataFrame([(100e3, 120e3), (120e3, 120e3), (140e3, 120e3)], "y double, p double")
    r = M.regression_metrics(const, "y", "p").first()
    assert r["mae"] > 0 and r["r2"] == 0.0
    zero_var = spark.createDataFrame([(5.0, 5.0), (5.0, 6.0)], "y double, p double")
    assert M.regression_metrics(zero_var, "y", "p").first()["r2"] == 0.0
    one = spark.createDataFrame([(5.0, 6.0)], "y double, p double")
    assert M.regression_metrics(one, "y", "p").first()["r2"] is None
    zero_y = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "y double, p double")
    assert M.regression_metrics(zero_y, "y", "p").first()["mape"] == pytest.approx(50.0)


def test_protected_never_features():
    with pytest.raises(ValueError):
        FeatureRoles(("age", "x"), ("c",), ("age",))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    vals = np.concatenate([rng.normal(size=3000), np.full(500, 1.25)])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    for q in (0.0, 0.1, 0.25, 0.5, 0.9, 1.0):
        assert Q.quantile_linear(df, "v", q) == pytest.approx(float(np.quantile(vals, q)), abs=1e-12)
    # force several refinement rounds with tiny bins/final size
    s = np.sort(vals)
    got = Q.order_statistics(df, "v", [0, 17, 1750, 3499], bins=4, final_rows=10)
    assert [got[k] for k in (0, 17, 1750, 3499)] == [s[0], s[17], s[1750], s[3499]]


def test_conformal_rank_edges(spark):
    assert CF.conformal_rank(10, 0.1) == 9  # k = ceil(11*0.9) = 10 > n-1
    assert CF.conformal_rank(1000, 0.1) == 901
    with pytest.raises(ValueError):
        CF.conformal_rank(5, 0.1)  # k = 6 > n
    res = np.arange(1, 11, dtype=float)
    df = spark.createDataFrame([(float(r), 0.0) for r in res], "y double, p double")
    q, n = CF.conformal_quantile(df, "y", "p", 0.1)
    assert n == 10 and q == float(np.quantile(res, math.ceil(11 * 0.9) / 10, method="higher"))


def test_parity_and_odds_edges(spark):
    rows = [("a", 10.0, 10.0), ("a", 1.0, 1.0), ("b", 1.0, 10.0), ("c", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, y double, p double")
    rates, disp = FA.fairness_metrics(df, ["g"], "y", "p", threshold=5.0)
    r = {x["group"]: x for x in rates.collect()}
    assert r["a"]["selection_rate"] == 0.5 and r["b"]["selection_rate"] == 1.0
    assert r["c"]["tpr"] == 0.0  # no positives (T5)
    d = disp.first()
    assert d["dp_difference"] == 1.0 and d["dp_ratio"] == 0.0
    assert d["eo_difference"] == 1.0


def test_mean_matching_equalises_group_means(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", 10.0), (None, 7.0)]
    df = spark.createDataFrame(rows, "g string, p double")
    out = FA.mean_match(df, "p", "g")
    means = {r["g"]: r["m"] for r in out.groupBy("g").agg(F.avg("calibrated").alias("m")).collect()}
    overall = (1 + 3 + 10 + 7) / 4
    assert means["a"] == pytest.approx(overall) and means["b"] == pytest.approx(overall)
    assert means[None] == 7.0


def test_psi_edges(spark):
    ref = spark.createDataFrame([(1.0,)] * 20, "x double")
    cur = spark.createDataFrame([(1.0,)] * 20, "x double")
    psi = DR.psi_numeric(DR._long_numeric(ref, cur, ["x"]), bins=10).first()["psi"]
    assert psi == pytest.approx(0.0)  # min = max widened by ±0.5, same bin
    cref = spark.createDataFrame([("a",)] * 10 + [("b",)] * 10, "c string")
    ccur = spark.createDataFrame([("a",)] * 10 + [("z",)] * 10, "c string")
    got = DR.psi_categorical(DR._long_categorical(cref, ccur, ["c"])).first()["psi"]
    e = {"a": .5, "b": .5, "z": 1e-4}
    a = {"a": .5, "b": 1e-4, "z": .5}
    want = sum((a[k] - e[k]) * math.log(a[k] / e[k]) for k in e)
    assert got == pytest.approx(want)


def test_chi2_yates_2x2(spark):
    cells = [("f", "0", "x", 10), ("f", "0", "y", 20), ("f", "1", "x", 30), ("f", "1", "y", 40)]
    df = spark.createDataFrame(cells, "feature string, row string, col string, o long")
    r = DR.chi2_table(df).first()
    # corrected statistic for [[10,20],[30,40]]
    n, rt, ct = 100, [30, 70], [40, 60]
    obs = [[10, 20], [30, 40]]
    want = sum((abs(obs[i][j] - rt[i] * ct[j] / n) - 0.5) ** 2 / (rt[i] * ct[j] / n)
               for i in range(2) for j in range(2))
    assert r["dof"] == 1 and r["chi2_statistic"] == pytest.approx(want)


def test_ks_statistic_matches_bruteforce(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=400).round(2), (rng.normal(size=300) + 0.3).round(2)
    ref = spark.createDataFrame([(float(v),) for v in a], "x double")
    cur = spark.createDataFrame([(float(v),) for v in b], "x double")
    got = DR.ks_statistic(DR._long_numeric(ref, cur, ["x"]), rows_per_task=50).first()["ks_statistic"]
    grid = np.union1d(a, b)
    want = max(abs(np.searchsorted(np.sort(a), g, "right") / len(a)
                   - np.searchsorted(np.sort(b), g, "right") / len(b)) for g in grid)
    assert got == pytest.approx(want)


def test_p_values_known():
    assert stats.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.f_sf(4.0, 2, 10) == pytest.approx(0.05285, abs=1e-4)
    assert stats.kolmogorov_sf(1.3580986393225505) == pytest.approx(0.05, abs=1e-6)


def test_similar_profiles_fallback_and_zero(spark):
    prof = [("r1", "L", "E", 5.0, 100.0), ("r1", "L", "E", 6.0, 200.0), ("r1", "L", "F", 5.0, 300.0)]
    prof += [("r2", "L", "E", float(i), 10.0 * i) for i in range(10)]
    P = spark.createDataFrame(prof, "job_role string, location string, education_level string, "
                                    "years_experience double, salary double")
    req = spark.createDataFrame([(1, "r1", "L", "E", 5.0), (2, "r2", "L", "E", 4.0),
                                 (3, "r9", "L", "E", 1.0)],
                                "id int, job_role string, location string, education_level string, "
                                "years_experience double")
    out = {r["id"]: r for r in SIM.similar_profiles(req, P).collect()}
    # r1: 2 band peers < 5 -> role fallback over 3 profiles
    assert out[1]["count"] == 3 and out[1]["median_salary"] == 200
    # r2: band 2..6 -> 5 peers (20..60)
    assert out[2]["count"] == 5 and out[2]["median_salary"] == 40
    assert out[2]["percentile_25"] == 30 and out[2]["percentile_75"] == 50
    # unknown role -> zeros
    assert out[3]["count"] == 0 and out[3]["median_salary"] == 0


def test_grouped_quantiles_exact_with_hot_group(spark):
    """Hot group forced through several refinement rounds; small groups take the
    bounded-map path; both equal NumPy's linear quantiles."""
    import collections
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.normal(size=20000).round(3)]
    rows += [("b", float(v)) for v in rng.integers(0, 5, 100)] + [("c", 7.0)]
    rows += [("d", float(v)) for v in rng.normal(size=7)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.5, 0.25, 0.75, 0.0, 1.0]
    got = {r["g"]: (r["n"], r["q"]) for r in
           Q.grouped_quantiles(df, ["g"], "v", qs, bins=8, final_rows=50).collect()}
    by = collections.defaultdict(list)
    for g, v in rows:
        by[g].append(v)
    for g, vs in by.items():
        n, q = got[g]
        assert n == len(vs)
        assert q == pytest.approx([float(np.quantile(vs, p)) for p in qs], abs=1e-9)


def test_ks_exact_over_many_sampled_ranges(spark):
    """Range bounds come from sampling, whose result depends on input order;
    the statistic must stay exact (the range id is checkpointed once)."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=6000).round(4), (rng.normal(size=5000) * 1.1).round(4)
    ref = spark.createDataFrame([(float(v),) for v in a], "x double").repartition(13)
    cur = spark.createDataFrame([(float(v),) for v in b], "x double").repartition(11)
    got = DR.ks_statistic(DR._long_numeric(ref, cur, ["x"]), rows_per_task=300).first()["ks_statistic"]
    grid = np.union1d(a, b)
    want = np.max(np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a)
                         - np.searchsorted(np.sort(b), grid, "right") / len(b)))
    assert got == pytest.approx(want)


def test_running_totals_hot_key_over_many_ranges(spark):
    """A key holding most rows spans many range partitions; sums stay exact."""
    from equiscope.operators.prefix import running_totals
    rng = np.random.default_rng(11)
    rows = [("hot", i, int(v)) for i, v in enumerate(rng.integers(0, 9, 3000))]
    rows += [("a", i, 1) for i in range(40)] + [(None, i, 2) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, o int, v long").repartition(7)
    got = {(r["k"], r["o"]): r["cum_v"]
           for r in running_totals(df, ["k"], ["o"], ["v"], rows_per_task=100).collect()}
    acc = {}
    for k, o, v in sorted(rows, key=lambda t: (t[0] is not None, t[0] or "", t[1])):
        acc[k] = acc.get(k, 0) + v
        assert got[(k, o)] == acc[k]
    assert len(got) == len(rows)


def test_qq_points_with_hot_value_in_chunks(spark):
    """Ranks 0..n-1 each once, values in sorted order, Filliben medians through
    Φ⁻¹; a value holding a third of the rows is expanded in many chunks."""
    from statistics import NormalDist

    from equiscope.operators.profile import qq_points
    rng = np.random.default_rng(2)
    vals = list(rng.normal(size=600).round(2)) + [0.5] * 300 + [None] * 4
    df = spark.createDataFrame([(None if v is None else float(v),) for v in vals], "r double").repartition(5)
    got = sorted((r["rank"], r["value"], r["theoretical"])
                 for r in qq_points(df, "r", chunk=7, rows_per_task=40).collect())
    xs = sorted(v for v in vals if v is not None)
    n = len(xs)
    assert [g[0] for g in got] == list(range(n)) and [g[1] for g in got] == xs
    m = [(i + 1 - 0.3175) / (n + 0.365) for i in range(n)]
    m[-1] = 0.5 ** (1 / n)
    m[0] = 1 - m[-1]
    assert [g[2] for g in got] == pytest.approx([NormalDist().inv_cdf(p) for p in m], abs=1e-12)


def test_global_rank_breaks_ties_by_other_columns(spark):
    from equiscope.operators.topk import global_rank
    rows = [(1.0, i) for i in range(50)] + [(float(i % 7), 100 + i) for i in range(60)]
    df = spark.createDataFrame(rows, "v double, id int").repartition(3)
    got = sorted((r["rank"], r["v"], r["id"]) for r in global_rank(df, "v", rows_per_task=9).collect())
    want = sorted(rows)
    assert [(g[1], g[2]) for g in got] == want and [g[0] for g in got] == list(range(len(rows)))


def test_quantile_match_exact_with_hot_group(spark):
    """Percent rank within the group mapped onto the overall linear quantile
    function (NumPy), over many small ranges; NULL group / value unchanged."""
    rng = np.random.default_rng(8)
    rows = [("hot", float(v)) for v in rng.normal(10, 2, 400).round(1)] + [("hot", 3.0)] * 80
    rows += [("b", float(v)) for v in rng.normal(12, 1, 60).round(1)] + [("c", 5.0)]
    rows += [(None, 1.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, p double").repartition(4)
    got = sorted((r["g"] or "", -1.0 if r["p"] is None else r["p"], r["calibrated"])
                 for r in FA.quantile_match(df, "p", "g", rows_per_task=37).collect())
    allv = np.sort([p for _, p in rows if p is not None])
    want = []
    for g, p in rows:
        if g is None or p is None:
            want.append((g or "", -1.0 if p is None else p, p))
            continue
        gv = [q for h, q in rows if h == g and q is not None]
        u = sum(q < p for q in gv) / (len(gv) - 1) if len(gv) > 1 else 0.0
        want.append((g, p, float(np.quantile(allv, u))))
    want.sort()
    assert [w[:2] for w in got] == [w[:2] for w in want]
    for a, b in zip(got, want):
        assert (a[2] is None and b[2] is None) or a[2] == pytest.approx(b[2], abs=1e-9)


def test_normal_ppf_expression_equals_stdlib(spark):
    from statistics import NormalDist

    from equiscope.functions.normal import normal_ppf
    ps = [1e-300, 1e-20, 1e-9, 0.001, 0.02425, 0.075, 0.3, 0.5, 0.5 + 1e-12, 0.9, 0.975, 1 - 1e-12]
    df = spark.createDataFrame([(p,) for p in ps] + [(0.0,), (1.0,), (None,)], "p double")
    got = {r["p"]: r["z"] for r in df.select("p", normal_ppf(F.col("p")).alias("z")).collect()}
    for p in ps:
        assert got[p] == pytest.approx(NormalDist().inv_cdf(p), rel=1e-14, abs=1e-14)
    assert math.isnan(got[0.0]) and math.isnan(got[1.0]) and got[None] is None


def test_band_quantiles_exact_over_refinement_rounds(spark):
    """Band statistics without request×profile pairs equal NumPy on the band,
    with windows forced through several rounds (tiny bins / final window)."""
    from equiscope.operators.similar import band_quantiles
    rng = np.random.default_rng(21)
    prof = [("a", float(x), float(v)) for x, v in zip(rng.integers(0, 21, 900) * 0.5,
                                                       rng.normal(100, 15, 900).round(1))]
    prof += [("a", 4.0, 77.0)] * 150 + [("b", 1.0, 5.0), ("b", 1.5, 7.0), ("b", 9.0, 1.0)]
    prof += [("a", None, 3.0), ("a", 2.0, None)]
    P = spark.createDataFrame(prof, "g string, x double, v double").repartition(5)
    reqs = [("a", e) for e in (0.0, 3.37, 4.0, 5.99, 10.0, 12.5, 20.0)] + [("b", 1.2), ("b", 5.0), ("c", 1.0)]
    R = spark.createDataFrame(reqs, "g string, e double")
    qs = [0.5, 0.25, 0.75]
    got = {(r["g"], r["e"]): (r["n"], r["q"]) for r in
           band_quantiles(R, P, ["g"], "e", "x", "v", 2.0, qs, bins=4, final_rows=6).collect()}
    for g, e in reqs:
        vals = [v for h, x, v in prof if h == g and x is not None and v is not None and abs(x - e) <= 2.0]
        if not vals:
            assert (g, e) not in got
            continue
        n, q = got[(g, e)]
        assert n == len(vals)
        assert q == pytest.approx([float(np.quantile(vals, p)) for p in qs], abs=1e-9)


def test_top_k_per_group_both_plans(spark):
    """Group-limit plan (k ≤ threshold) and salted two-phase plan agree with sorting."""
    from equiscope.operators.topk import top_k_per_group
    rows = [("hot", i, float((i * 37) % 101)) for i in range(2000)] + [("cold", i, float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, id int, s double").repartition(6)
    want = {g: sorted((s, i) for h, i, s in rows if h == g)[:7] for g in ("hot", "cold")}
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    old = spark.conf.get(key, "1000")
    try:
        for thr in ("1000", "3"):  # 3 < k forces the salted path
            spark.conf.set(key, thr)
            got = top_k_per_group(df, ["g"], [F.col("s"), F.col("id")], 7, salt_cols=["id"], salts=4).collect()
            for g in ("hot", "cold"):
                mine = sorted((r["rank"], r["s"], r["id"]) for r in got if r["g"] == g)
                assert [(s, i) for _, s, i in mine] == want[g]
                assert [r for r, _, _ in mine] == list(range(1, len(want[g]) + 1))
    finally:
        spark.conf.set(key, old)


def test_knn_peers_equals_bruteforce_with_hot_vectors_and_ties(spark):
    """Top-n by (distance, salary) over vectors equals a per-request brute force,
    including a vector shared by many profiles and ties at the cut-off distance."""
    rng = np.random.default_rng(4)
    prof = [("r", float(e), int(k), "A" if c else "B", float(s)) for e, k, c, s in
            zip(rng.integers(0, 8, 300), rng.integers(0, 3, 300), rng.integers(0, 2, 300),
                rng.integers(1, 60, 300) * 10)]
    prof += [("r", 3.0, 1, "A", 100.0 + i) for i in range(120)]  # one hot vector
    prof += [("r", 3.0, 1, "A", None), ("q", 1.0, 0, "A", 5.0), ("r", 3.0, None, "A", 1.0)]
    P = spark.createDataFrame(prof, "role string, exp double, k int, c string, salary double").repartition(4)
    reqs = [(1, "r", 3.0, 1, "A"), (2, "r", 0.0, 2, "B"), (3, "r", 7.5, 0, None), (4, "q", 1.0, 0, "B"),
            (5, "z", 1.0, 0, "A")]
    R = spark.createDataFrame(reqs, "id int, role string, exp double, k int, c string")
    n = 25
    got = {r["id"]: r for r in SIM.knn_peers(R, P, ["role"], "exp", {"exp": 2.0, "k": 1.5}, {"c": 1.0},
                                             n=n).collect()}
    for rid, role, e, k, c in reqs:
        cands = []
        for pr, pe, pk, pc, ps in prof:
            if pr != role or ps is None or pk is None or abs(pe - e) > 2.0:
                continue  # no salary or an undefined distance: not a peer
            d = math.sqrt(2.0 * (e - pe) ** 2 + 1.5 * (k - pk) ** 2 + (0.0 if pc == c else 1.0))
            cands.append((d, ps))
        top = sorted(cands)[:n]
        if not top:
            assert got[rid]["count"] is None
            continue
        sal = [s for _, s in top]
        assert got[rid]["count"] == len(top)
        assert got[rid]["max_distance"] == pytest.approx(top[-1][0])
        assert got[rid]["median_salary"] == int(np.quantile(sal, 0.5))
        assert got[rid]["percentile_25"] == int(np.quantile(sal, 0.25))
        assert got[rid]["percentile_75"] == int(np.quantile(sal, 0.75))


def test_similar_profiles_band_plan_equals_pair_plan_on_driver_data(spark):
    """Both exact plans of J1 give identical answers on every request (sf0.001)."""
    from equiscope.sources.tables import cand
    c = cand(spark, "/root/testdata/sf0.001")
    keys = ["job_role", "location", "education_level", "years_experience"]
    req = c.select("l_orderkey", "l_linenumber", *keys)
    prof = c.select(*keys, "salary")
    cols = ["l_orderkey", "l_linenumber", *SIM.STAT_COLS]
    a = SIM.similar_profiles(req, prof, method="bands").select(*cols)
    b = SIM.similar_profiles(req, prof, method="pairs").select(*cols)
    assert a.count() == b.count() == req.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_running_totals_nulls_first_and_running_max(spark):
    """NULL order values sort first in both the range split and the window;
    running max ignores NULL inputs."""
    from equiscope.operators.prefix import running_totals
    rows = [(None, 5, None)] + [(i, i % 4, float(i % 7) if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "o int, v long, m double").repartition(3)
    s = {r["o"]: r["cum_v"] for r in running_totals(df, [], ["o"], ["v"], rows_per_task=9).collect()}
    m = {r["o"]: r["mx"] for r in running_totals(df, [], ["o"], ["m"], ["mx"], rows_per_task=9,
                                                  how="max").collect()}
    acc, best = 0, None
    for o, v, x in sorted(rows, key=lambda t: (t[0] is not None, t[0] or 0)):
        acc += v
        best = x if best is None else (best if x is None else max(best, x))
        assert s[o] == acc and m[o] == best


def test_band_quantiles_edge_cases(spark):
    """One-value bands, bands of equal values (window collapses to a point),
    integer experience columns and NULL keys (no band)."""
    from equiscope.operators.similar import band_quantiles
    prof = [("a", 1, 50.0), ("b", 3, 7.0), ("b", 4, 7.0), ("b", 5, 7.0), ("c", 10, 1.0), ("c", 10, 9.0),
            (None, 1, 3.0)]
    P = spark.createDataFrame(prof, "g string, x int, v double")
    R = spark.createDataFrame([("a", 2), ("b", 4), ("c", 12), ("c", 13), (None, 1)], "g string, e int")
    got = {(r["g"], r["e"]): (r["n"], r["q"]) for r in
           band_quantiles(R, P, ["g"], "e", "x", "v", 2.0, [0.5, 0.25, 0.75], bins=2, final_rows=1).collect()}
    assert got[("a", 2)] == (1, [50.0, 50.0, 50.0])
    assert got[("b", 4)] == (3, [7.0, 7.0, 7.0])
    assert got[("c", 12)] == (2, [5.0, 3.0, 7.0])
    assert ("c", 13) not in got and (None, 1) not in got
