"""Approximate nearest neighbours with learned partitions.

1. **Fit** on at most about ``SAMPLE`` vectors chosen by a hash (the bound is
   a parameter): their k-nearest-neighbour graph is cut into equal parts by
   recursive bisection (a median cut along a main direction, then exchanges
   that lower the number of cut edges), and a small network learns the parts
   of a vector's neighbours from the vector. A fifth of the sample is kept from
   the fit: on it the ``mass`` is measured that leads queries to the wanted
   share of their neighbours.
2. **Index.** Every row goes to its most probable part.
3. **Search.** A query goes to its most probable parts until their
   probabilities sum to ``mass`` and they hold enough rows. Queries that go
   first to neighbouring parts form groups of bounded size. A task holds a
   group's queries with the k nearest found so far; the rows of the parts that
   any of them is led to stream past in blocks, each one matrix product with
   the queries led to its part, and of the best few the measure is computed
   again term by term in double precision on the given vectors. So a task
   gives k rows a query, however many parts the query is led to, and a row
   goes to a group once. Nothing is found but in the parts that a query is led
   to.

Equal vectors: of each distinct vector only the k + 1 rows of least id can
ever be among the k nearest, so the others are left out of the index without
changing any answer (the limit is applied before the shuffle). Rows with an
equal vector therefore make no hot part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .util import Scratch

SAMPLE, NEIGHBOURS, HIDDEN, ROWS_A_PART, MOST_PARTS, RECALL, BLOCK, GROUPS, QUERIES = 8192, 10, 256, 1500, 1024, 0.97, 2048, 12, 8192


@dataclass(frozen=True)
class Router:
    """A network of one hidden layer: vector -> probability of each part."""

    w1: object
    b1: object
    w2: object
    b2: object
    scale: float

    def probabilities(self, x):
        import numpy as np

        z = np.maximum((x * self.scale) @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def nearest_in_sample(x, k: int):
    """Indices of the k rows of largest inner product with each row, without itself."""
    import numpy as np

    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        s = x[a:a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a:a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def bisect(x, rows, edges, rounds: int = 30):
    """Halves of ``rows`` with few cut edges. ``edges``: pairs of places within ``rows``, both ways."""
    import numpy as np

    centred = x[rows] - x[rows].mean(0)
    direction = np.ones(x.shape[1]) / math.sqrt(x.shape[1])
    for _ in range(30):  # power iteration
        direction = centred.T @ (centred @ direction)
        direction /= max(1e-300, np.linalg.norm(direction))
    order = np.argsort(centred @ direction, kind="stable")
    side = np.zeros(len(rows), bool)
    side[order[len(rows) // 2:]] = True
    a, b = edges
    best, least = side.copy(), int((side[a] != side[b]).sum())
    for turn in range(rounds):
        gain = np.bincount(a, np.where(side[a] != side[b], 1, -1), minlength=len(rows))
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right))
        worth = int((gain[left[:n]] + gain[right[:n]] > 0).sum())
        if not worth:
            break
        swap = max(1, worth // (2 + turn // 4))  # not all at once: exchanged neighbours undo each other's gain
        side[left[:swap]], side[right[:swap]] = True, False
        cut = int((side[a] != side[b]).sum())
        if cut < least:
            best, least = side.copy(), cut
    return best


def balanced_parts(x, near, parts: int):
    """Part of each row: ``parts`` (a power of two) of equal size, by recursive bisection of the neighbour graph."""
    import numpy as np

    a = np.repeat(np.arange(len(x)), near.shape[1])
    b = near.ravel()
    a, b = np.r_[a, b], np.r_[b, a]
    part = np.zeros(len(x), np.int64)
    for level in range(parts.bit_length() - 1):
        new = part * 2
        for p in range(1 << level):
            rows = np.flatnonzero(part == p)
            if len(rows) < 2:
                continue
            at = np.full(len(x), -1)
            at[rows] = np.arange(len(rows))
            inside = (at[a] >= 0) & (at[b] >= 0)
            new[rows] += bisect(x, rows, (at[a[inside]], at[b[inside]]))
        part = new
    return part


def fit_router(x, parts: int, seed: int = 7, steps: int = 1500, batch: int = 256) -> Router:
    """Parts of the sample's graph, and a network fitted to the shares of parts among each row's neighbours."""
    import numpy as np

    near = nearest_in_sample(x, NEIGHBOURS)
    part = balanced_parts(x, near, parts)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1.0)
    np.add.at(goal, (np.arange(len(x)), part), 2.0)
    goal /= goal.sum(1, keepdims=True)
    rng = np.random.default_rng(seed)
    scale = 1.0 / max(1e-12, float(np.sqrt((x * x).mean())))
    x = x * scale
    w = [rng.normal(0, math.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, math.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for step in range(1, steps + 1):
        i = rng.integers(0, len(x), batch)
        h = np.maximum(x[i] @ w[0] + w[1], 0)
        z = h @ w[2] + w[3]
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - goal[i]) / batch
        dh = (d @ w[2].T) * (h > 0)
        rate = 2e-3 * (1 - step / (steps + 1))
        for k, g in enumerate((x[i].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8) - rate * 1e-3 * w[k]
    return Router(*w, scale)


def needed_mass(router: Router, x, k: int, recall: float) -> float:
    """The least mass by which the rows ``x``, unknown to the router, are led to ``recall`` of their k nearest among themselves.

    Among few rows the k nearest lie farther away than among all, so the
    figure errs to the side of more parts.
    """
    import numpy as np

    p = router.probabilities(x)
    order = np.argsort(-p, axis=1, kind="stable")
    ranked = np.take_along_axis(p, order, 1)
    before = np.empty_like(p)
    np.put_along_axis(before, order, np.cumsum(ranked, 1) - ranked, 1)  # a part's turn comes when this is below the mass
    need = np.sort(np.take_along_axis(before, p.argmax(1)[nearest_in_sample(x, k)], 1).ravel())
    return float(np.nextafter(need[math.ceil(recall * len(need)) - 1], 2.0)) if len(need) else 2.0


def query_groups(asked: dict[int, int], parts: int) -> tuple[dict[int, tuple[int, int]], int]:
    """Part -> (first group, number of groups) of the queries that go there first, and the number of groups.

    A group's queries go first to neighbouring parts. ``GROUPS`` groups or
    about twice as many, however many queries there are, until one would hold
    more than ``QUERIES``: then more of that size. A large part has several.
    """
    size = min(QUERIES, max(1, -(-sum(asked.values()) // GROUPS)))
    grid, group, held = {}, 0, 0
    for part in range(parts):
        n = asked.get(part, 0)
        if not n:
            continue
        if held and held + n > size:
            group, held = group + 1, 0
        many = -(-n // size)
        grid[part] = (group, many)
        group, held = (group + many, 0) if many > 1 else (group, held + n)
    return grid, group + (held > 0)


class Nearest:
    """The ``k`` nearest rows found so far of each query of a group; the parts' rows are offered piece by piece."""

    def __init__(self, k: int, parts: int):
        self.k, self.parts, self.asking = k, parts, []

    def ask(self, ids, x, led: list[list[int]]) -> None:
        """Queries, each with the parts it is led to: all before any row is offered."""
        import numpy as np

        goes = np.zeros((len(ids), self.parts), bool)
        for row, to in zip(goes, led):
            row[to] = True
        self.asking.append((ids.copy(), x.copy(), goes))

    def _begin(self) -> None:
        import numpy as np

        self.ids, self.x, self.goes = (np.concatenate(c) for c in zip(*self.asking))
        self.asking = []
        self.least = np.full(len(self.ids), -np.finfo(np.float64).max)  # a row below this is not among the k nearest
        self.vec = np.zeros((len(self.ids), self.k), np.int64)
        self.score = np.full((len(self.ids), self.k), -np.inf)
        self.held = np.zeros(len(self.ids), np.int64)

    def offer(self, part: int, ids, x) -> None:
        import numpy as np

        if self.asking:
            self._begin()
        led = np.flatnonzero(self.goes[:, part])
        order = np.argsort(ids, kind="stable")
        turn = np.empty(len(ids), np.int64)  # rows of one id come in turns, so that a piece has no id twice
        turn[order] = np.arange(len(ids)) - np.searchsorted(ids[order], ids[order])
        for t in range(int(turn.max()) + 1):
            rows = np.flatnonzero(turn == t)
            for a in range(0, len(rows), BLOCK):
                piece = rows[a:a + BLOCK]
                for b in range(0, len(led), BLOCK // 2):
                    self._compare(led[b:b + BLOCK // 2], ids[piece], x[piece])

    def _compare(self, asks, ids, x) -> None:
        import numpy as np

        scores = self.x[asks] @ x.T
        scores[self.ids[asks][:, None] == ids[None, :]] = -np.inf
        n = min(self.k, len(ids))
        edge = -np.partition(-scores, n - 1, axis=1)[:, n - 1]
        edge = np.where(np.isfinite(edge), edge - 1e-9 * np.maximum(1.0, np.abs(edge)), -np.finfo(np.float64).max)
        edge = np.maximum(edge, self.least[asks])
        q, c = np.nonzero(scores >= edge[:, None])
        if not len(q):
            return
        exact = (x[c] * self.x[asks[q]]).sum(1)
        better, where = np.unique(q, return_inverse=True)
        better = asks[better]
        own, place = np.nonzero(np.arange(self.k)[None, :] < self.held[better][:, None])
        row = np.concatenate([own, where])
        vec = np.concatenate([self.vec[better[own], place], ids[c]])
        score = np.concatenate([self.score[better[own], place], exact])
        order = np.lexsort((vec, -score, row))
        row, vec, score = row[order], vec[order], score[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (vec[1:] != vec[:-1]) | (score[1:] != score[:-1])]
        row, vec, score = row[new], vec[new], score[new]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        row, vec, score, rank = row[keep], vec[keep], score[keep], rank[keep]
        self.vec[better[row], rank], self.score[better[row], rank] = vec, score
        self.held[better] = np.bincount(row, minlength=len(better))
        last = self.score[better, self.k - 1]
        full = (self.held[better] == self.k) & np.isfinite(last)
        self.least[better[full]] = last[full] - 1e-9 * np.maximum(1.0, np.abs(last[full]))

    def rows(self) -> pa.RecordBatch:
        import numpy as np

        if self.asking:
            self._begin()
        q, place = np.nonzero(np.arange(self.k)[None, :] < self.held[:, None])
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.vec[q, place]), pa.array(self.score[q, place])], ["query_id", "vec_id", "score"])


def usable(df: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """(``vec_id``, ``vector`` as doubles) of the rows that take part: an id, and a vector without null or non-finite components that isn't all zero."""
    v = F.col("vector")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
            .where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, finite), F.lit(False)) & F.exists(v, lambda x: x != 0)))


def search(df: DataFrame, is_query, vector: str = "embedding", vec_id: str = "vec_id", k: int = 20, sample: int = SAMPLE, recall: float = RECALL,
           rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """The ``k`` rows of largest inner product found for each row for which ``is_query`` (a condition on ``vec_id``) holds.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties go to
    the smaller ``vec_id``. Candidates are all rows but those of the query's
    own id. Null ids, and vectors that are null, empty, zero or hold null or
    non-finite components, take no part. Wholly repeated rows count once; of
    rows that share an id with different vectors each counts. Vectors of other
    lengths than the most frequent one (ties: the shortest) take no part. An
    empty table gives an empty result. Other columns are not looked at.
    ``recall`` is the share of neighbours to be found, as measured on the part
    of the sample that is kept from the fit.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "ann")
    result = "query_id long, rank int, vec_id long, score double"
    rows = usable(df, vector, vec_id)
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], result)
    width = lengths[0]["n"]
    rows = rows.where(F.size("vector") == width)
    kept = (rows.distinct().withColumn("_r", F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))).where(F.col("_r") <= k + 1).drop("_r"))
    kept = scratch.table(kept, "distinct")
    total = kept.count()
    rate = min(1.0, sample / max(1, total))
    chosen = kept.where(F.pmod(F.xxhash64(F.lit("ann"), "vec_id"), F.lit(1_000_000)) < int(math.ceil(rate * 1_000_000))).orderBy("vec_id", "vector").collect()

    import numpy as np

    x = np.array([r["vector"] for r in chosen])
    parts = 1 << max(0, min(MOST_PARTS.bit_length() - 1, round(math.log2(max(1.0, total / rows_a_part)))))
    while parts > 1 and len(x) < 16 * parts:
        parts //= 2
    fitted, mass = None, 2.0
    if parts > 1:
        apart = np.arange(len(x)) % 5 == 4
        fitted = fit_router(x[~apart], parts)
        mass = needed_mass(fitted, x[apart], max(1, min(k, int(apart.sum()) // 50)), recall)
    router = spark.sparkContext.broadcast(tuple(vars(fitted).values()) if fitted is not None else None)

    def vectors(batch: pa.RecordBatch):
        return np.ascontiguousarray(batch.column(batch.schema.get_field_index("vector")).flatten().to_numpy()).reshape(-1, width)

    def probable(x):
        return Router(*router.value).probabilities(x) if router.value is not None else np.ones((len(x), 1))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("part", pa.array(probable(vectors(batch)).argmax(1).astype(np.int32)))

    index = scratch.table(kept.mapInArrow(placed, "vec_id long, vector array<double>, part int"), "index")
    held = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = np.array([held.get(p, 0) for p in range(parts)])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probable(vectors(batch))
            order = np.argsort(-p, axis=1, kind="stable")
            before = np.cumsum(np.take_along_axis(p, order, 1), 1) - np.take_along_axis(p, order, 1)
            rows_before = np.cumsum(sizes[order], 1) - sizes[order]
            go = (before < mass) | (rows_before < 20 * k)
            lists = pa.array([o[g].tolist() for o, g in zip(order.astype(np.int32), go)], pa.list_(pa.int32()))
            yield batch.append_column("parts", lists).append_column("main", pa.array(order[:, 0].astype(np.int32)))

    asking = rows.where(is_query).distinct()
    queries = scratch.table(asking.mapInArrow(routed, "vec_id long, vector array<double>, parts array<int>, main int"), "queries")
    asked = {r["main"]: r["n"] for r in queries.groupBy("main").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not asked:
        return spark.createDataFrame([], result)
    grid, groups = query_groups(asked, parts)
    at = F.element_at(F.create_map(*[F.lit(v) for p in sorted(grid) for v in (p, F.array(*map(F.lit, grid[p])))]), F.col("main"))
    queries = queries.withColumn("group", (F.element_at(at, 1) + F.pmod(F.xxhash64("vec_id", "vector"), F.element_at(at, 2))).cast("int"))
    wanted = queries.select("group", F.explode("parts").alias("part")).groupBy("part").agg(F.collect_set("group").alias("groups"))
    right = queries.select("group", F.lit(-1).alias("part"), "vec_id", "vector", "parts")
    left = (index.join(F.broadcast(wanted.withColumnRenamed("part", "_p")), F.col("part") == F.col("_p"))
            .select(F.explode("groups").alias("group"), "part", "vec_id", "vector", F.lit(None).cast("array<int>").alias("parts")))
    dealt = right.unionByName(left).repartitionById(groups, F.col("group")).sortWithinPartitions("group", "part")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, of = None, None
        for batch in batches:
            group, part = (batch.column(i).to_numpy() for i in (0, 1))
            ids, x = batch.column(2).to_numpy(), vectors(batch)
            starts = [0, *(np.flatnonzero((np.diff(group) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(ids)]
            for a, b in zip(starts, starts[1:]):
                if group[a] != of:
                    if best is not None:
                        yield best.rows()
                    best, of = Nearest(k, parts), group[a]
                if part[a] < 0:
                    best.ask(ids[a:b], x[a:b], batch.column(4).slice(a, b - a).to_pylist())
                else:
                    best.offer(int(part[a]), ids[a:b], x[a:b])
        if best is not None:
            yield best.rows()

    found = dealt.mapInArrow(found, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
