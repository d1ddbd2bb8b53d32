"""Similar-profile statistics as batch joins.

J1 — for each request: peers with equal role, location and education and
experience within ±tol; fewer than ``min_peers`` ⇒ fall back to all profiles
of the role; none ⇒ zeros. Statistics: count, median, p25, p75 (linear
interpolation, truncated to int).

Plan, and why it holds at scale:

* requests are reduced to their distinct keys first, so the answer is
  computed once per key however many requests share it;
* the band condition becomes an equi-join by binning experience into cells
  of width 2·tol: a request probes exactly the two cells its band overlaps,
  a profile sits in one cell, and the exact band test is a residual filter.
  The join is therefore a sort-merge/hash equi-join on (role, location,
  education, cell) — hot (role, location, education) keys are split by
  cell, and AQE's skew-join splitting handles what remains;
* each profile meets at most the distinct request keys in its band, so the
  pair count is linear in the profile count (bounded by the number of
  distinct experience values in a 2·tol window), never all pairs of a group;
* the role fallback is one pre-aggregated row per role, joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dlit
from .quantile import grouped_quantiles

STAT_COLS = ("count", "median_salary", "percentile_25", "percentile_75")


QS = [0.5, 0.25, 0.75]


def _group_stats(df: DataFrame, keys: list, salary: str, accuracy: int | None) -> DataFrame:
    """keys, n, q = [median, p25, p75] per group.

    Exact by default, via distributed per-group rank selection (no group's
    values are merged in one task); ``accuracy`` switches to a sketch.
    """
    if accuracy is None:
        return grouped_quantiles(df, keys, salary, QS, out="q", count_col="n")
    return df.groupBy(*keys).agg(F.count(F.col(salary)).alias("n"),
                                 F.percentile_approx(F.col(salary), QS, accuracy).alias("q"))


def band_quantiles(request_keys: DataFrame, profiles: DataFrame, keys: Sequence[str], exp: str,
                   pexp: str, value: str, tol: float, qs: Sequence[float], bins: int = 1024,
                   final_rows: int = 250_000, max_rounds: int = 30) -> DataFrame:
    """Exact linear quantiles of ``value`` over each request's band: profiles
    with equal ``keys`` and ``pexp`` within ±``tol`` of the request's ``exp``.

    Result: keys, exp, ``n`` (band size) and ``q`` (quantiles in ``qs``
    order) per distinct request key with a non-empty band. No request is
    paired with individual profiles:

    * band membership is decided per (keys, experience value) *cell* — a join
      of distinct request keys with distinct profile cells, whose size depends
      on the value domain, not on how many profiles share a cell;
    * round 0: a histogram per (keys, cell, bucket) on the group's value range
      (one partial-aggregated pass over the profiles), summed per band, locates
      the bucket of every target rank;
    * later rounds refine only active (band, window) pairs: profiles are
      joined to the windows of their own round-0 bucket, so a profile meets
      only the few windows whose narrow value range it falls in; each window
      shrinks ~``bins``× per round;
    * windows with ≤ ``final_rows`` values are ranked directly.
    State tables are checkpointed each round; the result is materialised.
    """
    from pyspark.sql.window import Window as W

    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(profiles.sparkSession)
    keys = list(keys)
    width = 2.0 * tol
    X, V, E = F.col("_x"), F.col("_v"), F.col(exp)
    in_band = X.between(E - dlit(tol), E + dlit(tol))
    prof = (profiles.select(*keys, F.col(pexp).cast("double").alias("_x"),
                            F.col(value).cast("double").alias("_v"))
            .where(X.isNotNull() & V.isNotNull() & ~F.isnan(V)))
    rng = prof.groupBy(*keys).agg(F.min("_v").alias("_glo"), F.max("_v").alias("_ghi"),
                                  F.count(F.lit(1)).alias("_gn"))
    span = F.col("_ghi") - F.col("_glo")
    # round-0 buckets per group: about 256 values each, at most ``bins`` (balance only)
    gb = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil(F.col("_gn") / F.lit(256.0)))).cast("double")
    b0 = F.when(span == 0, F.lit(0)).otherwise(
        F.least(F.floor((V - F.col("_glo")) / span * gb), gb - F.lit(1.0))).cast("int")
    P = prof.join(rng, keys).select(*keys, "_x", "_v", b0.alias("_b0")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cells = P.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_n"))
        rkc = request_keys.select(*keys, exp).withColumn("_cell", F.explode(F.array_distinct(F.array(
            F.floor((E - dlit(tol)) / dlit(width)), F.floor((E + dlit(tol)) / dlit(width))))))
        bx = (rkc.join(cells.withColumn("_cell", F.floor(X / dlit(width))), keys + ["_cell"])
              .where(in_band).select(*keys, exp, "_x", "_n")).checkpoint(eager=True)
        bn = bx.groupBy(*keys, exp).agg(F.sum("_n").alias("_N"))
        h0 = P.groupBy(*keys, "_x", "_b0").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"),
                                               F.max("_v").alias("_hi"))
        bh = (bx.join(h0, keys + ["_x"]).groupBy(*keys, exp, "_b0")
              .agg(F.sum("_c").alias("nb"), F.min("_lo").alias("lob"), F.max("_hi").alias("hib")))
        bh = bh.withColumn("cum", F.coalesce(F.sum("nb").over(
            W.partitionBy(*keys, exp).orderBy("_b0").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        rank_exprs = []
        for q in qs:
            h = (F.col("_N") - 1).cast("double") * F.lit(float(q))
            rank_exprs += [F.floor(h).cast("long"), F.ceil(h).cast("long")]
        ranks = bn.select(*keys, exp, F.explode(F.array_distinct(F.array(*rank_exprs))).alias("rank"))
        R = F.col("rank")
        done = (F.col("lo") == F.col("hi")) | (F.col("nwin") <= F.lit(final_rows))
        state = (ranks.join(bh, keys + [exp])
                 .where((R >= F.col("cum")) & (R < F.col("cum") + F.col("nb")))
                 .select(*keys, exp, "rank", "_b0", F.col("lob").alias("lo"), F.col("hib").alias("hi"),
                         F.col("cum").alias("below"), F.col("nb").alias("nwin"))
                 .withColumn("done", done).checkpoint(eager=True))
        in_win = V.between(F.col("lo"), F.col("hi"))
        for _ in range(max_rounds):
            active = state.where(~F.col("done"))
            if active.isEmpty():
                break
            wins = active.select(*keys, exp, "_b0", "lo", "hi").distinct()
            b = F.least(F.floor((V - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float(bins))),
                        F.lit(bins - 1)).cast("int")
            hist = (P.join(wins, keys + ["_b0"]).where(in_band & in_win)
                    .groupBy(*keys, exp, "_b0", "lo", "hi", b.alias("b"))
                    .agg(F.count(F.lit(1)).alias("nb"), F.min("_v").alias("lob"), F.max("_v").alias("hib")))
            hist = hist.withColumn("cum", F.coalesce(F.sum("nb").over(
                W.partitionBy(*keys, exp, "lo", "hi").orderBy("b").rowsBetween(W.unboundedPreceding, -1)),
                F.lit(0)))  # ≤ bins rows per window
            moved = (active.join(hist, keys + [exp, "_b0", "lo", "hi"])
                     .where((R >= F.col("below") + F.col("cum")) & (R < F.col("below") + F.col("cum") + F.col("nb")))
                     .select(*keys, exp, "rank", "_b0", F.col("lob").alias("lo"), F.col("hib").alias("hi"),
                             (F.col("below") + F.col("cum")).alias("below"), F.col("nb").alias("nwin")))
            state = (state.where(F.col("done")).drop("done").unionByName(moved)
                     .withColumn("done", done).checkpoint(eager=True))
        else:  # pragma: no cover - each round shrinks every window
            raise RuntimeError("band quantile refinement did not converge")
        point = state.where(F.col("lo") == F.col("hi")).select(*keys, exp, "rank", F.col("lo").alias("val"))
        open_w = state.where(F.col("lo") < F.col("hi"))
        fw = open_w.select(*keys, exp, "_b0", "lo", "hi", "below").distinct()
        wr = W.partitionBy(*keys, exp, "lo", "hi").orderBy("_v")  # ≤ final_rows values per window
        ranked = (P.join(fw, keys + ["_b0"]).where(in_band & in_win)
                  .select(*keys, exp, "lo", "hi", (F.row_number().over(wr) - 1 + F.col("below")).alias("rank"),
                          F.col("_v").alias("val")))
        picked = (open_w.select(*keys, exp, "lo", "hi", "rank").join(ranked, keys + [exp, "lo", "hi", "rank"])
                  .select(*keys, exp, "rank", "val"))
        per = (point.unionByName(picked).groupBy(*keys, exp)
               .agg(F.map_from_entries(F.collect_list(F.struct("rank", "val"))).alias("_m")))
        quants = []
        for q in qs:
            h = (F.col("_N") - 1).cast("double") * F.lit(float(q))
            lo_v = F.element_at("_m", F.floor(h).cast("long"))
            hi_v = F.element_at("_m", F.ceil(h).cast("long"))
            # Spark's percentile interpolation, so results equal ``percentile``
            quants.append(F.when(F.floor(h) == F.ceil(h), lo_v)
                          .otherwise((F.ceil(h) - h) * lo_v + (h - F.floor(h)) * hi_v))
        return (bn.join(per, keys + [exp])
                .select(*keys, exp, F.col("_N").alias("n"), F.array(*quants).alias("q"))
                .checkpoint(eager=True))
    finally:
        P.unpersist(blocking=True)


def similar_profiles(requests: DataFrame, profiles: DataFrame,
                     keys: Sequence[str] = ("job_role", "location", "education_level"),
                     exp: str = "years_experience", salary: str = "salary",
                     fallback_key: str = "job_role", tol: float = 2.0, min_peers: int = 5,
                     accuracy: int | None = None, method: str = "bands") -> DataFrame:
    """Requests with ``count, median_salary, percentile_25, percentile_75`` appended.

    Exact by default with ``method="bands"`` (``band_quantiles``: no request
    is paired with individual profiles). ``method="pairs"`` materialises the
    (request key, profile) pairs of each band and aggregates them — exact
    too, but its size grows with the distinct request experiences per band.
    ``accuracy`` switches the pairs path to ``percentile_approx``.
    """
    if method not in ("bands", "pairs"):
        raise ValueError("method must be 'bands' or 'pairs'")
    keys = list(keys)
    width = 2.0 * tol
    rk = requests.select(*keys, exp).where(F.col(exp).isNotNull()).distinct()
    # two probe cells per request key: floor((e-tol)/w) and floor((e+tol)/w)
    rk_cells = rk.withColumn("_cell", F.explode(F.array_distinct(F.array(
        F.floor((F.col(exp) - dlit(tol)) / dlit(width)),
        F.floor((F.col(exp) + dlit(tol)) / dlit(width))))))
    # profiles feed two statistics passes; their projection is cached while
    # those run (the exact path materialises its results) and released after
    cols = list(dict.fromkeys(keys + [fallback_key, exp, salary]))
    pcache = profiles.select(*cols).persist(StorageLevel.MEMORY_AND_DISK) if accuracy is None else None
    src = pcache if pcache is not None else profiles
    try:
        # role statistics first: each statistics pass caches its own projection
        # and releases it, so at most two copies of the profiles are cached at once
        role = _group_stats(src.select(fallback_key, salary), [fallback_key], salary, accuracy) \
            .select(fallback_key, F.col("n").alias("rn"), F.col("q").alias("rq"))
        if accuracy is None and method == "bands":
            band = band_quantiles(rk, src, keys, exp, exp, salary, tol, QS)
        else:
            prof = (src.select(*keys, F.col(exp).alias("_pexp"), salary)
                    .where(F.col("_pexp").isNotNull())
                    .withColumn("_cell", F.floor(F.col("_pexp") / dlit(width))))
            pairs = (rk_cells.join(prof, keys + ["_cell"])
                     .where(F.col("_pexp").between(F.col(exp) - dlit(tol), F.col(exp) + dlit(tol))))
            band = _group_stats(pairs.select(*keys, exp, salary), keys + [exp], salary, accuracy)
    finally:
        if pcache is not None:
            pcache.unpersist(blocking=True)
    per_key = (rk.join(band, keys + [exp], "left")
               .join(role, fallback_key, "left"))
    use_band = F.coalesce(F.col("n"), F.lit(0)) >= min_peers
    n = F.when(use_band, F.col("n")).otherwise(F.coalesce(F.col("rn"), F.lit(0)))
    q = F.when(use_band, F.col("q")).otherwise(F.col("rq"))

    def pick(i):
        return F.coalesce(F.element_at(q, i).cast("int"), F.lit(0))  # int() truncates

    per_key = per_key.select(*keys, exp, n.cast("bigint").alias("count"),
                             pick(1).alias("median_salary"), pick(2).alias("percentile_25"),
                             pick(3).alias("percentile_75"))
    # null-safe key equality so requests with NULL keys get the zero answer
    cond = [requests[k].eqNullSafe(per_key[k]) for k in keys + [exp]]
    out = requests.join(per_key, cond, "left").select(
        requests["*"], *[F.coalesce(per_key[c], F.lit(0)).alias(c) if c == "count"
                         else F.coalesce(per_key[c], F.lit(0)).alias(c) for c in STAT_COLS])
    return out.withColumn("count", F.col("count").cast("bigint"))


def knn_peers(requests: DataFrame, profiles: DataFrame, exact: Sequence[str], exp: str,
              numeric_weights: Mapping[str, float], categorical_weights: Mapping[str, float],
              salary: str = "salary", tol: float = 2.0, n: int = 50, salt: int = 16) -> DataFrame:
    """Top-n nearest peers by weighted Euclidean distance within the band, then stats.

    distance = sqrt(Σ w·Δ² over numeric features + Σ w·[a ≠ b] over categorical);
    peers are ordered by (distance, salary), so the statistics do not depend on
    which tied peer is kept. Requests are reduced to distinct feature keys
    (equal features ⇒ equal answer) and the answer joined back null-safely.

    All profiles with the same feature vector are equidistant from a request,
    so profiles are first reduced to one row per distinct vector: its count
    and its ``n`` smallest salaries (a window with a row limit, which Spark
    evaluates as a per-partition group limit before the shuffle, then once
    more after it; a hot vector is additionally spread over ``salt`` buckets).
    Request keys then meet *vectors* in their band — a join sized by the
    feature domain, not by the profile count; vectors are ranked by distance
    per request, and only those that can reach the top ``n`` (fewer than
    ``n`` peers strictly closer) are expanded to their ≤ ``n`` salaries.
    """
    from pyspark.sql.window import Window as W

    from .topk import top_k_per_group

    width = 2.0 * tol
    feats = list(numeric_weights) + list(categorical_weights)
    kcols = list(dict.fromkeys(list(exact) + [exp] + feats))
    pk = [f"_p_{c}" for c in kcols]
    rk = requests.select(*kcols).where(F.col(exp).isNotNull()).distinct()
    rq = rk.select(*[F.col(c).alias(f"_k_{c}") for c in kcols])
    rq = rq.withColumn("_cell", F.explode(F.array_distinct(F.array(
        F.floor((F.col(f"_k_{exp}") - dlit(tol)) / dlit(width)),
        F.floor((F.col(f"_k_{exp}") + dlit(tol)) / dlit(width))))))
    pf = (profiles.select(*[F.col(c).alias(f"_p_{c}") for c in kcols], F.col(salary).alias("_sal"))
          .where(F.col(f"_p_{exp}").isNotNull() & F.col("_sal").isNotNull()))  # a peer has a salary
    # one row per distinct profile vector: count and the n smallest salaries
    cnt = pf.groupBy(*pk).agg(F.count(F.lit(1)).alias("_c"))
    low = top_k_per_group(pf, pk, [F.col("_sal")], n,
                          salt_cols=["_sal", f"_p_{exp}"], salts=salt, rank_col="_r")
    sal = low.groupBy(*pk).agg(F.array_sort(F.collect_list("_sal")).alias("_s"))  # ≤ n values
    on_v = [F.col(f"_v{i}").eqNullSafe(F.col(c)) for i, c in enumerate(pk)]
    vec = (cnt.join(sal.select(*[F.col(c).alias(f"_v{i}") for i, c in enumerate(pk)], "_s"), on_v, "left")
           .select(*pk, "_c", F.coalesce(F.col("_s"), F.array().cast("array<double>")).alias("_s"))
           .withColumn("_cell", F.floor(F.col(f"_p_{exp}") / dlit(width))))
    on = [F.col(f"_k_{c}") == F.col(f"_p_{c}") for c in exact] + [rq["_cell"] == vec["_cell"]]
    cand = (rq.join(vec, on)
            .where(F.col(f"_p_{exp}").between(F.col(f"_k_{exp}") - dlit(tol),
                                              F.col(f"_k_{exp}") + dlit(tol))))
    d2 = None
    for f, w in numeric_weights.items():
        diff = F.col(f"_k_{f}").cast("double") - F.col(f"_p_{f}").cast("double")
        term = dlit(w) * diff * diff
        d2 = term if d2 is None else d2 + term
    for f, w in categorical_weights.items():
        term = dlit(w) * F.when(F.col(f"_k_{f}").eqNullSafe(F.col(f"_p_{f}")), dlit(0.0)).otherwise(dlit(1.0))
        d2 = term if d2 is None else d2 + term
    kk = [f"_k_{c}" for c in kcols]
    # a peer needs a defined distance (a NULL numeric feature leaves it undefined)
    scored = cand.select(*kk, F.sqrt(d2).alias("distance"), "_c", "_s").where(F.col("distance").isNotNull())
    # peers strictly closer than each vector: running count over distances
    wd = W.partitionBy(*kk).orderBy("distance").rangeBetween(W.unboundedPreceding, W.currentRow)
    ws = W.partitionBy(*kk, "distance")
    closer = F.sum("_c").over(wd) - F.sum("_c").over(ws)
    needed = scored.withColumn("_closer", closer).where(F.col("_closer") < F.lit(n))
    peers = needed.select(*kk, "distance", F.explode("_s").alias(salary))
    w2 = W.partitionBy(*kk).orderBy(F.col("distance"), F.col(salary))
    top = peers.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= n)
    stats = top.groupBy(*kk).agg(
        F.count(F.lit(1)).alias("count"),
        F.percentile(F.col(salary), [0.5, 0.25, 0.75]).alias("q"),  # ≤ n values per group
        F.max("distance").alias("max_distance"))
    stats = stats.select(*kk, "count",
                         F.element_at("q", 1).cast("int").alias("median_salary"),
                         F.element_at("q", 2).cast("int").alias("percentile_25"),
                         F.element_at("q", 3).cast("int").alias("percentile_75"),
                         "max_distance")
    cond = [requests[c].eqNullSafe(stats[f"_k_{c}"]) for c in kcols]
    return requests.join(stats, cond, "left").drop(*kk)
