"""Exact order statistics of a whole column without gathering it anywhere.

Spark's exact ``percentile`` keeps a value→count map per group and merges the
maps of a group in one task: for a *global* quantile the group is the whole
table. Here the k-th smallest value is found by histogram refinement instead:

1. one pass computes min, max and count;
2. each round buckets the rows still inside the current window into ``bins``
   equal-width buckets (a partial-aggregated ``groupBy``; at most ``bins``
   rows reach the driver), finds the bucket holding rank k and narrows the
   window to that bucket's [min, max];
3. when the window holds ≤ ``final_rows`` rows (a bound we set) or is a
   single value, the window is sorted distributed and the exact element taken
   with ``offset``/``limit`` on a ``TakeOrderedAndProject`` of bounded size.

Every round is a full distributed pass with the window pushed down as a
filter; a handful of rounds suffices because each shrinks the window by
about ``bins``×. The projected column is persisted for the rounds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BINS = 4096
_FINAL_ROWS = 50_000


def _share(x, lo, hi):
    """Place of x in [lo, hi] from 0 to 1, for bounds up to the largest doubles apart."""
    wide = (x / 2 - lo / 2) / (hi / 2 - lo / 2)
    return F.when(hi - lo < F.lit(float("inf")), (x - lo) / (hi - lo)).otherwise(wide)


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL meets NULL, as grouping has it; the right side's keys go."""
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in keys]
    return left.join(renamed, cond, how).drop(*[f"_right_{c}" for c in keys])


def _kth(vals: DataFrame, k: int, lo: float, hi: float, below: int, n_win: int,
         bins: int, final_rows: int, hist_cache: dict) -> float:
    x = F.col("x")
    while True:
        if lo == hi:
            return lo
        win = vals.where((x >= F.lit(lo)) & (x <= F.lit(hi)))
        if n_win <= final_rows:
            row = win.orderBy("x").offset(k - below).limit(1).collect()
            return float(row[0]["x"])
        key = (lo, hi)
        if key not in hist_cache:  # ranks in the same window share one pass
            b = F.least(F.floor(_share(x, F.lit(lo), F.lit(hi)) * bins), F.lit(bins - 1)).cast("int")
            hist_cache[key] = (win.groupBy(b.alias("b"))
                               .agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"),
                                    F.max(x).alias("hi"))
                               .orderBy("b").collect())
        acc = below
        for h in hist_cache[key]:
            if acc + h["n"] > k:
                lo, hi, below, n_win = float(h["lo"]), float(h["hi"]), acc, int(h["n"])
                break
            acc += h["n"]
        else:  # pragma: no cover - counts always cover k
            raise RuntimeError("rank outside window")


def _values(df: DataFrame, column: str) -> DataFrame:
    return (df.select(F.col(column).cast("double").alias("x"))
            .where(F.col("x").isNotNull() & ~F.isnan(F.col("x"))))


def _select(vals: DataFrame, st, ranks, bins: int, final_rows: int) -> dict[int, float]:
    """Values at ranks; ``st``: the row of ``_stats``. Infinite values are counted, not bucketed."""
    cache: dict = {}
    out = {}
    n, below, above = int(st["n"]), int(st["n_neg"] or 0), int(st["n_pos"] or 0)
    for k in sorted(set(ranks)):
        if not 0 <= k < n:
            raise ValueError(f"rank {k} outside 0..{n - 1}")
        if k < below or k >= n - above:
            out[k] = -math.inf if k < below else math.inf
        else:
            out[k] = _kth(vals, k, float(st["lo"]), float(st["hi"]), below, n - below - above, bins, final_rows, cache)
    return out


def _stats_columns():
    """Count, counts of infinities and bounds of the finite values of ``x``."""
    x = F.col("x")
    finite = F.when(F.abs(x) < F.lit(math.inf), x)
    return [F.count(F.lit(1)).alias("n"), F.count(F.when(x == F.lit(-math.inf), 1)).alias("n_neg"),
            F.count(F.when(x == F.lit(math.inf), 1)).alias("n_pos"), F.min(finite).alias("lo"), F.max(finite).alias("hi")]


def _between(low: float, high: float, share: float) -> float:
    """Linear interpolation; a value between equal infinities is that infinity."""
    return low if low == high or share == 0 else low + share * (high - low)


def order_statistics(df: DataFrame, column: str, ranks: Sequence[int],
                     bins: int = _BINS, final_rows: int = _FINAL_ROWS) -> dict[int, float]:
    """Exact values at 0-based ranks among the non-null values of ``column``."""
    vals = _values(df, column).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        st = vals.agg(*_stats_columns()).first()
        return _select(vals, st, ranks, bins, final_rows)
    finally:
        vals.unpersist(blocking=True)


def quantiles_linear(df: DataFrame, column: str, qs: Sequence[float],
                     bins: int = _BINS, final_rows: int = _FINAL_ROWS) -> list[float | None]:
    """NumPy's default (linear) quantiles, exact, sharing every pass across ``qs``."""
    vals = _values(df, column).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        st = vals.agg(*_stats_columns()).first()
        n = int(st["n"])
        if n == 0:
            return [None for _ in qs]
        hs = [(n - 1) * q for q in qs]
        ranks = {r for h in hs for r in (math.floor(h), math.ceil(h))}
        v = _select(vals, st, ranks, bins, final_rows)
        return [_between(v[math.floor(h)], v[math.ceil(h)], h - math.floor(h)) for h in hs]
    finally:
        vals.unpersist(blocking=True)


def value_at_rank(df: DataFrame, column: str, rank_of_n) -> tuple[float, int]:
    """(value at rank ``rank_of_n(n)``, n) with n counted in the same pass as min/max."""
    vals = _values(df, column).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        st = vals.agg(*_stats_columns()).first()
        n = int(st["n"])
        k = rank_of_n(n)
        return _select(vals, st, [k], _BINS, _FINAL_ROWS)[k], n
    finally:
        vals.unpersist(blocking=True)


def quantile_linear(df: DataFrame, column: str, q: float) -> float | None:
    """NumPy's default (linear) quantile, exact; None on an empty column."""
    return quantiles_linear(df, column, [q])[0]


def quantile_higher(df: DataFrame, column: str, rank: int) -> float:
    """The value at a given 0-based rank (NumPy's "higher" rule takes ceil(h))."""
    return order_statistics(df, column, [rank])[rank]


def median(df: DataFrame, column: str) -> float | None:
    return quantile_linear(df, column, 0.5)


# ------------------------------------------------------------- many columns
def column_quantiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float], fold: str | None = None,
                     bins: int = 1024, final_rows: int = 4096) -> dict[tuple[str, int | None], list[float | None]]:
    """Exact linear quantiles of several columns: ``{(column, None): ...}`` over all rows and, with
    ``fold``, ``{(column, f): ...}`` over the rows of the other folds.

    Every pass serves all columns and training sets at once: a value is counted
    in the bin of the window it lies in, per fold, so a training set is a sum of
    folds. Windows of a column are equal or disjoint. A window of up to
    ``final_rows`` rows is counted by value, which ends its search. A pass sends
    at most ``bins`` counts a window and fold to the driver. ``df`` is scanned
    about four times: hand in a table that is cheap to scan.
    """
    x, one = F.col("x"), F.lit(1)
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)])
    side = F.col(fold).cast("int") if fold else F.lit(None).cast("int")
    long = (df.select(side.alias("f"), F.explode(cells).alias("cx")).select("f", "cx.c", "cx.x").where(x.isNotNull() & ~F.isnan(x)))
    stats = long.groupBy("c", "f").agg(*_stats_columns()).collect()
    sets: list[int | None] = [None]
    if fold:  # from the rows: a fold may lack values in every column
        sets += sorted(r["f"] for r in df.select(side.alias("f")).distinct().collect() if r["f"] is not None)
    within = lambda f, s: s is None or (f is not None and f != s)
    found: dict[tuple, float] = {}
    open_: dict[tuple, tuple] = {}  # (column, set, rank) -> (column, lo, hi), values of the set below the window
    rows_in: dict[tuple, int] = {}  # rows of all folds in a window
    sizes: dict[tuple, int] = {}
    for i in range(len(columns)):
        mine = [r for r in stats if r["c"] == i]
        ends = [(r["lo"], r["hi"]) for r in mine if r["lo"] is not None]
        window = (i, min(e[0] for e in ends), max(e[1] for e in ends)) if ends else None
        rows_in[window] = sum(r["n"] - r["n_neg"] - r["n_pos"] for r in mine)
        for s in sets:
            n, below, above = (sum(r[k] for r in mine if within(r["f"], s)) for k in ("n", "n_neg", "n_pos"))
            sizes[i, s] = n
            for k in {r for q in qs if n for r in (math.floor((n - 1) * q), math.ceil((n - 1) * q))}:
                if k < below or k >= n - above:
                    found[i, s, k] = -math.inf if k < below else math.inf
                else:
                    open_[i, s, k] = window, below
    while True:
        for t, (window, _) in list(open_.items()):
            if window[1] == window[2]:
                found[t] = window[1]
                del open_[t]
        if not open_:
            break
        windows = sorted({window for window, _ in open_.values()})
        at = None
        for w, (i, lo, hi) in enumerate(windows):
            few = rows_in[i, lo, hi] <= final_rows
            b = F.least(F.floor(_share(x, F.lit(lo), F.lit(hi)) * bins), F.lit(bins - 1)).cast("int")
            cell = F.struct(F.lit(w).alias("w"), (F.lit(None).cast("int") if few else b).alias("b"), (x if few else F.lit(None).cast("double")).alias("v"))
            cond = (F.col("c") == i) & (x >= F.lit(lo)) & (x <= F.lit(hi))
            at = F.when(cond, cell) if at is None else at.when(cond, cell)
        counted = (long.select("f", "x", at.alias("at")).where(F.col("at").isNotNull())
                   .groupBy("at.w", "at.b", "at.v", "f").agg(F.count(one).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect())
        bins_of: dict[int, dict] = {}
        for r in counted:
            cell = bins_of.setdefault(r["w"], {}).setdefault((r["b"], r["v"]), [r["lo"], r["hi"], {}])
            cell[0], cell[1] = min(cell[0], r["lo"]), max(cell[1], r["hi"])
            cell[2][r["f"]] = r["n"]
        ordered = {w: sorted(c.values(), key=lambda c: c[0]) for w, c in bins_of.items()}
        for (i, s, k), (window, below) in list(open_.items()):
            for lo, hi, ns in ordered[windows.index(window)]:
                m = sum(n for f, n in ns.items() if within(f, s))
                if below + m > k:
                    open_[i, s, k] = (i, lo, hi), below
                    rows_in[i, lo, hi] = sum(ns.values())
                    break
                below += m
            else:  # pragma: no cover - counts always cover k
                raise RuntimeError("rank outside window")
    out: dict[tuple, list] = {}
    for i, c in enumerate(columns):
        for s in sets:
            hs = [(sizes[i, s] - 1) * q for q in qs]
            out[c, s] = [_between(found[i, s, math.floor(h)], found[i, s, math.ceil(h)], h - math.floor(h)) if sizes[i, s] else None for h in hs]
    return out


# --------------------------------------------------------------- per group
def grouped_quantiles(df: DataFrame, keys: Sequence[str], column: str, qs: Sequence[float],
                      bins: int = 1024, final_rows: int = 250_000,
                      out: str = "q", count_col: str = "n") -> DataFrame:
    """Exact linear-interpolation quantiles of ``column`` for every group of ``keys``.

    Result: keys, ``count_col`` (non-null values) and ``out`` = array of the
    quantiles in ``qs`` order (like ``percentile(column, qs)``). Groups without
    values are absent.

    One counting pass splits the groups. Groups with ≤ ``final_rows`` values
    use Spark's ``percentile``, whose per-group value map is then bounded by
    ``final_rows``. Larger groups are never merged in one task: their target
    ranks are located by rounds of histogram refinement run for all large
    groups at once — a state table of (group, rank, window) rows is joined
    to the values, each round aggregates ≤ ``bins`` buckets per window
    (partial aggregation spreads a hot group over all tasks), windows shrink
    ~``bins``× per round, and the last step ranks ≤ ``final_rows`` values per
    window. The state is checkpointed each round (reliable checkpoint).
    """
    from pyspark.sql.window import Window as W

    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    keys = list(keys)
    x = F.col("x")
    vals = (df.select(*keys, F.col(column).cast("double").alias("x"))
            .where(x.isNotNull() & ~F.isnan(x))).persist(StorageLevel.MEMORY_AND_DISK)
    cached = vals

    def small_part(v):
        return v.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col),
                                    F.percentile(x, [float(q) for q in qs]).alias(out))

    try:
        # every pass below reads the cached projection; results are one row
        # per group and are materialised before the cache is released
        g = vals.groupBy(*keys).agg(*[c for c in _stats_columns()]).checkpoint(eager=True)
        g = g.select(*keys, F.col("n").alias("_n"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                     F.col("n_neg").alias("_neg"), F.col("n_pos").alias("_pos"))
        large = g.where(F.col("_n") > F.lit(final_rows))
        n_large = large.count()  # on the checkpointed per-group table
        if n_large == 0:
            return small_part(vals).checkpoint(eager=True)
        # a large group has over final_rows values, so they and their windows are few: broadcast, for a
        # join by shuffle would take all values of a group to one task
        hot = F.broadcast(large.select(*keys))
        small = small_part(_null_safe(vals, hot, keys, "left_anti")).checkpoint(eager=True)
        vals = _null_safe(cached, hot, keys, "left_semi")
        rank_exprs = []
        for q in qs:
            h = (F.col("_n") - 1).cast("double") * F.lit(float(q))
            rank_exprs += [F.floor(h).cast("long"), F.ceil(h).cast("long")]
        low, high = F.col("rank") < F.col("_neg"), F.col("rank") >= F.col("_n") - F.col("_pos")
        end = F.when(low, F.lit(-math.inf)).when(high, F.lit(math.inf))  # an infinite rank needs no window
        state = (large.select(*keys, "_n", "_lo", "_hi", "_neg", "_pos",
                              F.explode(F.array_distinct(F.array(*rank_exprs))).alias("rank"))
                 .select(*keys, "rank", F.coalesce(end, "_lo").alias("lo"), F.coalesce(end, "_hi").alias("hi"),
                         F.col("_neg").alias("below"), (F.col("_n") - F.col("_neg") - F.col("_pos")).alias("nwin")))
        done = (F.col("lo") == F.col("hi")) | (F.col("nwin") <= F.lit(final_rows))
        state = state.withColumn("done", done).checkpoint(eager=True)
        while True:
            active = state.where(~F.col("done"))
            if active.isEmpty():
                break
            windows = active.select(*keys, "lo", "hi").distinct()
            b = F.least(F.floor(_share(x, F.col("lo"), F.col("hi")) * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
            hist = (_null_safe(vals, F.broadcast(windows), keys)
                    .where((x >= F.col("lo")) & (x <= F.col("hi")))
                    .groupBy(*keys, "lo", "hi", b.alias("b"))
                    .agg(F.count(F.lit(1)).alias("nb"), F.min("x").alias("lob"), F.max("x").alias("hib")))
            wcum = W.partitionBy(*keys, "lo", "hi").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
            hist = hist.withColumn("cum", F.coalesce(F.sum("nb").over(wcum), F.lit(0)))  # ≤ bins rows
            moved = (_null_safe(active, hist, keys + ["lo", "hi"])
                     .where((F.col("rank") >= F.col("below") + F.col("cum"))
                            & (F.col("rank") < F.col("below") + F.col("cum") + F.col("nb")))
                     .select(*keys, "rank", F.col("lob").alias("lo"), F.col("hib").alias("hi"),
                             (F.col("below") + F.col("cum")).alias("below"), F.col("nb").alias("nwin")))
            state = (state.where(F.col("done")).drop("done")
                     .unionByName(moved).withColumn("done", done).checkpoint(eager=True))
        point = state.where(F.col("lo") == F.col("hi")).select(*keys, "rank", F.col("lo").alias("v"))
        open_w = state.where(F.col("lo") < F.col("hi"))
        # ranks sharing a window share ``below``: rank each distinct window once
        # (≤ final_rows values per partition), then equi-join the target ranks
        wins = open_w.select(*keys, "lo", "hi", "below").distinct()
        wr = W.partitionBy(*keys, "lo", "hi").orderBy("x")
        ranked = (_null_safe(vals, F.broadcast(wins), keys).where((x >= F.col("lo")) & (x <= F.col("hi")))
                  .select(*keys, "lo", "hi", (F.row_number().over(wr) - 1 + F.col("below")).alias("rank"),
                          F.col("x").alias("v")))
        picked = (open_w.select(*keys, "lo", "hi", "rank").transform(lambda d: _null_safe(d, ranked, [*keys, "lo", "hi", "rank"]))
                  .select(*keys, "rank", "v"))
        values = point.unionByName(picked)
        per = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_m"))
        quants = []
        for q in qs:
            h = (F.col("_n") - 1).cast("double") * F.lit(float(q))
            lo_v = F.element_at("_m", F.floor(h).cast("long"))
            hi_v = F.element_at("_m", F.ceil(h).cast("long"))
            # Spark's percentile interpolation, so both paths agree bit for bit
            quants.append(F.when((F.floor(h) == F.ceil(h)) | (lo_v == hi_v), lo_v)
                          .otherwise((F.ceil(h) - h) * lo_v + (h - F.floor(h)) * hi_v))
        big = (_null_safe(large, per, keys)
               .select(*keys, F.col("_n").alias(count_col), F.array(*quants).alias(out))
               .checkpoint(eager=True))  # small result; computed before the cache is released
        return small.unionByName(big)
    finally:
        cached.unpersist(blocking=True)
