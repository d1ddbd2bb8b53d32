"""Whitening of embeddings: principal components by contour integration.

1. **Covariance.** One pass sums the scaled integers exactly, the second centres
   them (``n * x - S`` is exact) and adds up products; tasks send one matrix.
2. **Slices.** The symmetric matrix is brought to tridiagonal form once; by
   Sylvester's law the signs of its Sturm sequence count the eigenvalues above
   any number. Bisection on that count finds the level that leaves the wanted
   number above it, and cuts the interval above into slices of few eigenvalues.
3. **Projection (FEAST).** Each slice is enclosed by a circle. The quadrature of
   the resolvent along it, ``sum w (z I - V)^-1 Y``, is a filter that keeps the
   eigenvectors inside; a Spark task per circle and node solves its complex
   shifted system. Rayleigh-Ritz extracts values and vectors from the filtered
   block, and the two steps repeat until the residuals reach rounding.
4. **Verification.** Each slice must hold as many Ritz values as its inertia
   count says; a miss starts it again with a larger block.
5. **Whitening.** Rows are centred exactly, projected and divided by the root of
   the eigenvalue; a last pass measures the covariance of the result.

Only matrices of the vectors' width squared reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import packed

NODES, SLICE, TURNS = 16, 8, 30
#: Scaled components from here on aren't exact as doubles.
MOST = float(1 << 53)
NEW = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


# ------------------------------------------------------------ the spectrum
def tridiagonal(v):
    """(diagonal, off-diagonal) of an orthogonally similar matrix, by Householder reflections."""
    import numpy as np

    a = np.array(v, float)
    for k in range(len(a) - 2):
        x = a[k + 1:, k].copy()
        x[0] += math.copysign(np.linalg.norm(x), x[0])
        size = x @ x
        if size == 0:
            continue
        p = a[k + 1:, k + 1:] @ x * (2 / size)
        p -= x * (p @ x / size)
        a[k + 1:, k + 1:] -= np.outer(x, p) + np.outer(p, x)
        reflected = a[k + 1:, k] - x * (2 * (x @ a[k + 1:, k]) / size)
        a[k + 1:, k] = a[k, k + 1:] = reflected
    return np.diag(a).copy(), np.diag(a, 1).copy()


def count_above(diagonal, off, levels):
    """How many eigenvalues lie above each level: the positive terms of the Sturm sequence (inertia of the shifted matrix)."""
    import numpy as np

    levels = np.asarray(levels, float)
    least = np.finfo(float).tiny ** 0.5 + np.finfo(float).eps * (np.abs(diagonal).max() + (np.abs(off).max() if len(off) else 0)) * 1e-8
    q = diagonal[0] - levels
    count = (q > 0).astype(int)
    for d, e in zip(diagonal[1:], off):
        q = np.where(np.abs(q) < least, -least, q)
        q = d - levels - e * e / q
        count += q > 0
    return count


def slices(diagonal, off, top: int, most: int = SLICE) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) of disjoint intervals that hold the ``top`` largest eigenvalues.

    A slice has at most ``most`` of them, within a factor of four, and ends in
    the gaps around them; eigenvalues that lie closer together than 1e-11 of
    the largest stay in one slice.
    """
    radius = float(max(abs(diagonal).max() + 2 * (abs(off).max() if len(off) else 0), 1e-300))
    above = lambda level: int(count_above(diagonal, off, [level])[0])
    apart = 1e-11 * radius

    def under(high: float, wanted: int) -> float:
        """The highest level found that has at least ``wanted`` eigenvalues above it."""
        low = -radius - apart
        while high - low > apart:
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= wanted else (low, middle)
        return low

    def moved(level: float, way: int) -> float:
        """The level moved up or down as far as doubled steps meet no eigenvalue."""
        here, step = above(level), apart
        while above(level + 2 * way * step) == here and step < radius / 8:
            step *= 2
        return level + way * step if above(level + way * step) == here else level

    out, high, held = [], radius + 4 * apart, 0
    while held < top:
        largest = under(high, held + 1)
        wanted = min(top, held + most, max(held + 1, above(largest / 4)))
        low = moved(under(high, wanted), -1)
        out.append((low, min(high, moved(largest + 2 * apart, 1)), above(low) - held))
        held, high = above(low), low
    return out


def feast(spark, v, intervals: list[tuple[float, float, int]], nodes: int = NODES, seed: int = 11):
    """(eigenvalues, eigenvectors) inside the intervals, falling. A task per interval and quadrature node solves its shifted system."""
    import numpy as np

    width, rng, shared = len(v), np.random.default_rng(seed), spark.sparkContext.broadcast(v)
    scale = max(abs(low) + abs(high) for low, high, _ in intervals)
    extra = {i: max(4, n // 2) for i, (_, _, n) in enumerate(intervals)}
    block = {i: rng.normal(size=(width, min(width, n + extra[i]))) for i, (_, _, n) in enumerate(intervals)}
    done: dict[int, tuple] = {}

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for re, im, wre, wim, y in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                y = np.frombuffer(y).reshape(width, -1)
                made.append((complex(wre, wim) * np.linalg.solve(complex(re, im) * np.eye(width) - shared.value, y)).real.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["i", "q"])

    angles, weights = np.polynomial.legendre.leggauss(nodes)  # on the upper half circle; the lower half is its conjugate
    for turn in range(TURNS):
        asked = []
        for i, (low, high, _) in enumerate(intervals):
            if i not in done:
                middle, radius = (low + high) / 2, (high - low) / 2
                for a, w in zip(angles, weights):
                    turned = np.exp(1j * math.pi / 2 * (a + 1))
                    z, weight = middle + radius * turned, w / 2 * radius * turned
                    asked.append((i, float(z.real), float(z.imag), float(weight.real), float(weight.imag), bytearray(block[i].tobytes())))
        if not asked:
            break
        table = spark.createDataFrame(asked, "i int, re double, im double, wre double, wim double, y binary").repartition(min(len(asked), 4 * len(block)))
        filtered: dict[int, object] = {}
        for r in table.mapInArrow(solved, "i int, q binary").collect():
            filtered[r["i"]] = filtered.get(r["i"], 0) + np.frombuffer(r["q"]).reshape(width, -1)
        for i, q in filtered.items():
            low, high, wanted = intervals[i]
            basis, _ = np.linalg.qr(q)
            values, turned = np.linalg.eigh(basis.T @ v @ basis)
            vectors = basis @ turned
            inside = (values > low) & (values <= high)
            residual = np.linalg.norm(v @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0)
            if inside.sum() == wanted and (not wanted or residual.max() <= 4e-15 * width ** 0.5 * scale or turn >= 5 and residual.max() <= 1e-12 * scale):
                done[i] = values[inside], vectors[:, inside]
            elif turn % 3 == 2:  # the inertia count says that some are missed, or they converge slowly: a larger block
                extra[i] = 2 * extra[i] + 4
                block[i] = np.c_[vectors, rng.normal(size=(width, min(width, wanted + extra[i]) - vectors.shape[1]))] if vectors.shape[1] < min(width, wanted + extra[i]) else vectors
            else:
                block[i] = vectors
    shared.unpersist()
    if len(done) != len(intervals):
        raise ArithmeticError("some slices of the spectrum did not converge to their inertia counts")
    values, vectors = np.concatenate([d[0] for d in done.values()]), np.concatenate([d[1] for d in done.values()], 1)
    order = np.argsort(-values, kind="stable")
    vectors, _ = np.linalg.qr(vectors[:, order])  # slices are orthogonal to rounding already
    return values[order], vectors


# ------------------------------------------------------------ the table
def usable(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """``_row`` and ``_v`` (doubles) of the rows whose vector isn't null or empty and holds no null, non-finite or overlarge entry."""
    v = F.col("_v")
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST / scale)
    return (df.select(packed(df).alias("_row"), F.col(f"`{vector}`").cast("array<double>").alias("_v"))
            .where((F.size(v) > 0) & F.coalesce(F.forall(v, fits), F.lit(False))))


def scaled(batch: pa.RecordBatch, at: int, width: int, scale: int, shift: int):
    """The batch's vectors as rows of integers."""
    import numpy as np

    x = np.ascontiguousarray(batch.column(at).flatten().to_numpy()).reshape(-1, width)
    return np.floor(scale * x).astype(np.int64) + shift


def centred(x, n: int, total: list[int]):
    """``n * x - S``, exact: as 64-bit integers where they fit, else as Python's."""
    import numpy as np

    largest = int(np.abs(x).max(initial=0)) * n + max(map(abs, total))
    return n * x - np.array(total, np.int64) if largest < 1 << 62 else n * x.astype(object) - np.array(total, object)


def whiten(df: DataFrame, vector: str = "embedding", components: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """A row per usable input row and component: the input columns without the vector, and ``component`` (from 1, by falling eigenvalue), ``n``,
    ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    An entry c becomes the integer floor(scale * c) + shift. Rows whose vector
    is null or empty, holds null or non-finite entries, or entries whose
    scaled value is 2^53 or more, take no part, nor do vectors of another
    length than the most frequent one (ties: the shortest). Components whose
    eigenvalue is zero to rounding can't be whitened and are left out, so
    fewer than ``components`` may come; a table of one distinct vector, or an
    empty one, gives no row. ``deviation`` is null where it does not fit a
    long. Repeated rows and rows with null in other columns count like any
    other. An input column named like a new one gives way to it.
    """
    import numpy as np

    spark, kept = df.sparkSession, [c for c in df.columns if c != vector and c not in NEW]
    rows = usable(df, vector, scale)
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept)
    schema = fields + "component int, n long, deviation long, whitened double, explained double, identity_error double"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per length: rows, and exact sums of each entry in two halves."""
        held: dict[int, list] = {}
        for batch in batches:
            lengths = batch.column(0).value_lengths().to_numpy()
            for length in np.unique(lengths):
                x = scaled(batch.filter(pa.array(lengths == length)), 0, int(length), scale, shift)
                h = held.setdefault(int(length), [0, [0] * int(length)])
                h[0] += len(x)
                h[1] = [s + (int(a) << 32) + int(b) for s, a, b in zip(h[1], (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))]
        for length, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([length] * length, pa.int32()), pa.array(range(length), pa.int32()), pa.array([n] * length, pa.int64()),
                                              pa.array([str(v) for v in s], pa.string())], ["width", "at", "n", "s"])

    totals = (rows.select("_v").mapInArrow(sums, "width int, at int, n long, s string").groupBy("width", "at")
              .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")))
    most = totals.where("at = 0").orderBy(F.desc("n"), "width").limit(1).collect()
    if not most:
        return spark.createDataFrame([], schema)
    width, n = most[0]["width"], most[0]["n"]
    total = [int(r["s"]) for r in totals.where(F.col("width") == width).orderBy("at").collect()]
    rows = rows.where(F.size("_v") == width)

    def matrix(table: DataFrame, block, side: int):
        """The sum over all rows of the products of the columns of ``block(batch)``: a matrix a task, added up by Spark."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((side, side))
            for batch in batches:
                if batch.num_rows:
                    y = block(batch)
                    held += y.T @ y
            i, j = np.triu_indices(side)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(held[i, j])], ["i", "j", "v"])

        out = np.zeros((side, side))
        for r in table.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
        return out / n

    centre = lambda batch, at: centred(scaled(batch, at, width, scale, shift), n, total).astype(float) / n
    v = matrix(rows.select("_v"), lambda batch: centre(batch, 0), width)
    trace = float(np.trace(v))
    diagonal, off = tridiagonal(v)
    rank = int(count_above(diagonal, off, [trace * width * 1e-15])[0]) if trace > 0 else 0
    top = min(components, rank)
    if not top:
        return spark.createDataFrame([], schema)
    values, vectors = feast(spark, v, slices(diagonal, off, top))
    values, vectors = values[:top], vectors[:, :top]
    onto = vectors / np.sqrt(values)
    # the constant column measures the mean of the result, which is centred before multiplying
    product = matrix(rows.select("_v"), lambda batch: np.c_[centre(batch, 0) @ onto, np.ones(batch.num_rows)], top + 1)
    covariance = product[:top, :top] - np.outer(product[:top, top], product[:top, top])
    error = float(np.abs(covariance - np.eye(top)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                exact = centred(scaled(batch, 1, width, scale, shift), n, total)
                squares = exact.astype(object) if exact.dtype == object or float(np.abs(exact).max()) ** 2 * width >= 2.0 ** 62 else exact
                deviation = (squares * squares).sum(1)
                deviation = [int(d) if d < 1 << 63 else None for d in deviation] if squares.dtype == object else deviation
                count = batch.num_rows
                row = np.repeat(np.arange(count), top)
                given = batch.column(0)
                columns = [given.field(given.type.get_field_index(c)).take(pa.array(row)) for c in kept]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), count)), pa.array(np.full(count * top, n)), pa.array(deviation, pa.int64()).take(pa.array(row)),
                     pa.array((exact.astype(float) / n @ onto).ravel()), pa.array(np.tile(values / trace, count)), pa.array(np.full(count * top, error))], [*kept, *NEW])

    return rows.select("_row", "_v").mapInArrow(run, schema)
