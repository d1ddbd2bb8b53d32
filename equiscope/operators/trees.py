"""Boosted regression trees grown from histograms, all training sets of a table together (M6, M7).

The algorithm is Spark ML's ``GBTRegressor`` (squared error, variance gain, at
most ``bins`` bins a number whose thresholds come from the same sample, one-hot
levels as two-way splits), so the trees are the same. What differs is the work:
features are turned into bin numbers once, for all training sets, and written as
blocks of some 65,000 rows; a pass over the blocks then serves the current level
of every model, where the estimator makes five jobs a tree and set over cached
rows. A pass sends counts and sums per (model, node, bin) only.

A row's number of bins is packed: features are grouped, the bins of a group are
one number, and a tree of up to 64 leaves is a table of leaf masks per group
(a row's leaf is the lowest bit left by its groups' masks).

Tables of up to ``LOCAL_ROWS`` rows are grown by one task per model, which holds
the blocks, with the same code for histograms and splits.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..roles import FeatureRoles
from ..session import held

#: Rows of a table whose models are grown by a task each (some 30 bytes a row and five sets).
LOCAL_ROWS = 1_000_000
#: Rows of a block, cells of a group of features, rounds after which blocks are written anew with the predictions so far.
_BLOCK, _CELLS, _FRESH = 65_536, 4096, 5


@dataclass(frozen=True)
class Boost:
    """Squared-error boosting: the first tree counts whole, the others ``rate``; ``subsample`` of the rows a tree."""

    rounds: int
    depth: int
    rate: float = 0.1
    subsample: float = 1.0
    min_leaf: int = 1
    seed: int = 42

    def weight(self, tree: int) -> float:
        return 1.0 if tree == 0 else self.rate


# ------------------------------------------------------------------- features
@dataclass(frozen=True)
class Encoder:
    """Bin numbers of rows as one training set sees them: filled and standardised numbers, levels with the level that stands for NULL."""

    numbers: tuple  # (column, fill, mean, deviation, thresholds)
    levels: tuple  # (column, levels of the table, level that stands for NULL)

    @property
    def columns(self) -> list[str]:
        return [c for c, *_ in (*self.numbers, *self.levels)]

    @property
    def sizes(self) -> list[int]:
        return [len(n[4]) + 1 for n in self.numbers] + [len(lv[1]) + 1 for lv in self.levels]

    def codes(self, rows: pd.DataFrame) -> list[np.ndarray]:
        out = []
        for c, fill, mean, deviation, thresholds in self.numbers:
            x = rows[c].to_numpy(dtype=float, na_value=np.nan)
            z = (np.where(rows[c].isna(), np.nan if fill is None else fill, x) - (np.nan if mean is None else mean)) / deviation
            if not np.isfinite(z).all():
                raise ValueError(f"{c}: numbers must be finite, and some must be there")
            out.append(np.searchsorted(thresholds, z, side="left"))
        for c, levels, mode in self.levels:
            found = pd.Index(levels).get_indexer(rows[c].where(rows[c].notna(), mode)) if levels else np.full(len(rows), -1)
            out.append(np.where(found < 0, len(levels), found))
        return out


def grouped(numbers: int, sizes: Sequence[int]) -> list[list[int]]:
    """Features packed into groups of at most ``_CELLS`` cells, numbers (which differ by training set) apart from levels."""
    groups: list[list[int]] = []
    for part in (range(numbers), range(numbers, len(sizes))):
        mine: list[list[int]] = []
        for i in sorted(part, key=lambda i: -sizes[i]):
            room = next((g for g in mine if math.prod(sizes[j] for j in g) * sizes[i] <= _CELLS), None)
            if room is None:
                mine.append([i])
            else:
                room.append(i)
        groups += mine
    return groups


class Layout:
    """Where bins and splits lie: shared by the sets, whose bins are counted up to the largest."""

    def __init__(self, encoders: Sequence[Encoder]):
        self.numbers = len(encoders[0].numbers)
        self.sizes = [max(s) for s in zip(*[e.sizes for e in encoders])]
        self.groups = grouped(self.numbers, self.sizes)
        self.starts = np.cumsum([0, *self.sizes])
        splits = [(f, (0, b) if f < self.numbers else (b, b)) for f, n in enumerate(self.sizes) for b in range(n - 1)]
        self.feature = np.array([f for f, _ in splits], dtype=np.int64)
        self.low = np.array([s[0] for _, s in splits], dtype=np.int64)
        self.high = np.array([s[1] for _, s in splits], dtype=np.int64)
        self.at = {f: (g, math.prod(self.sizes[j] for j in group[k + 1:])) for g, group in enumerate(self.groups) for k, f in enumerate(group)}
        self.cells = [math.prod(self.sizes[j] for j in g) for g in self.groups]

    def packed(self, codes: Sequence[np.ndarray]) -> list[np.ndarray]:
        out = []
        for group, cells in zip(self.groups, self.cells):
            c = np.zeros(len(codes[0]), dtype=np.int64)
            for f in group:
                c = c * self.sizes[f] + codes[f]
            out.append(c.astype(np.uint16 if cells <= 65_536 else np.int64))
        return out

    def unpacked(self, packed: Sequence[np.ndarray]) -> np.ndarray:
        return np.stack([packed[self.at[f][0]].astype(np.int64) // self.at[f][1] % n for f, n in enumerate(self.sizes)])


def histogram(layout: Layout, packed: Sequence[np.ndarray], node: np.ndarray, nodes: int, target: np.ndarray, weight: np.ndarray | None = None,
              codes: np.ndarray | None = None) -> np.ndarray:
    """(2, nodes, bins of all features): rows (or their weights) and sums of ``target``; rows whose node is ``nodes`` count nothing."""
    out = np.zeros((2, nodes, layout.starts[-1]))
    if weight is not None:
        target = target * weight
    wide = (nodes + 1) * sum(layout.cells) <= 4 * len(node)
    codes = layout.unpacked(packed) if codes is None and not wide else codes
    for group, cells, c in zip(layout.groups, layout.cells, packed):
        for some in ([group] if wide else [[f] for f in group]):
            n = cells if wide else layout.sizes[some[0]]
            at = node * n + (c if wide else codes[some[0]])
            for k, w in ((0, weight), (1, target)):
                flat = np.bincount(at, w, (nodes + 1) * n)[:nodes * n].reshape(nodes, *[layout.sizes[f] for f in some])
                for i, f in enumerate(some):
                    out[k, :, layout.starts[f]:layout.starts[f + 1]] = flat.sum(tuple(j + 1 for j in range(len(some)) if j != i))
    return out


# ---------------------------------------------------------------------- trees
class Tree:
    """Nodes as arrays (``left`` -1: a leaf; the right child follows the left one) and the open nodes of the deepest level."""

    def __init__(self):
        self.feature, self.low, self.high, self.left = (np.full(1, v, dtype=np.int64) for v in (0, 0, 0, -1))
        self.value, self.open, self.level, self._masks = np.zeros(1), np.zeros(1, dtype=np.int64), 0, None

    @property
    def arrays(self) -> tuple:
        """What a task returns: executors can't import this module."""
        return self.feature, self.low, self.high, self.left, self.value

    @classmethod
    def of(cls, arrays: tuple) -> Tree:
        tree = cls()
        (tree.feature, tree.low, tree.high, tree.left, tree.value), tree.open = arrays, tree.open[:0]
        return tree

    @property
    def places(self) -> np.ndarray:
        """The place of each node among the open ones; their number for the others."""
        out = np.full(len(self.left), len(self.open), dtype=np.int64)
        out[self.open] = np.arange(len(self.open))
        return out

    def grow(self, layout: Layout, hist: np.ndarray, depth: int, min_leaf: int) -> None:
        """Splits the open nodes by the largest gain, as Spark ML: the first of equal ones, none without a gain."""
        self._masks = None
        first = slice(layout.starts[0], layout.starts[1])
        total = hist[:, :, first].sum(2)
        parts = [[], []]
        for f in range(len(layout.sizes)):
            h = hist[:, :, layout.starts[f]:layout.starts[f + 1] - 1]
            h = h.cumsum(2) if f < layout.numbers else h
            for k in (0, 1):
                parts[k].append(h[k])
        (n, s), (m, t) = (np.concatenate(p, 1) for p in parts), total[:, :, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where((n >= min_leaf) & (m - n >= min_leaf) & (n > 0) & (m - n > 0), s * s / n + (t - s) ** 2 / (m - n), -np.inf)
            whole = np.where(total[0] > 0, total[1] ** 2 / total[0], 0.0)
            mean = np.where(total[0] > 0, total[1] / total[0], 0.0)
        if self.level == 0:
            self.value = mean
        if not score.shape[1]:
            self.open = self.open[:0]
            return
        most = score.max(1, keepdims=True)
        best = (score >= most - 1e-12 * np.abs(most)).argmax(1)  # whatever the order in which sums were added up
        row = np.arange(len(best))
        cut = np.nonzero(score[row, best] - whole > 1e-12 * whole)[0]
        b = best[cut]
        to = self.open[cut]
        self.feature[to], self.low[to], self.high[to] = layout.feature[b], layout.low[b], layout.high[b]
        self.left[to] = len(self.left) + 2 * np.arange(len(cut))
        more = 2 * len(cut)
        sides = np.stack([s[cut, b] / n[cut, b], (t[cut, 0] - s[cut, b]) / (m[cut, 0] - n[cut, b])], 1).ravel()
        self.value = np.r_[self.value, sides]
        fresh = np.arange(len(self.left), len(self.left) + more)
        for name, v in (("feature", 0), ("low", 0), ("high", 0), ("left", -1)):
            setattr(self, name, np.r_[getattr(self, name), np.full(more, v, dtype=np.int64)])
        self.level += 1
        self.open = fresh if self.level < depth else fresh[:0]

    def step(self, codes: np.ndarray, node: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The child that each row goes to."""
        at = np.arange(codes.shape[1])[rows]
        c = codes[self.feature[node], at]
        return self.left[node] + 1 - ((c >= self.low[node]) & (c <= self.high[node]))

    def leaf(self, layout: Layout, packed: Sequence[np.ndarray], codes: np.ndarray | None = None) -> np.ndarray:
        """The node where each row ends."""
        if (self.left < 0).sum() <= 64:
            tables, ends = self.masks(layout)
            alive = tables[0][packed[0]]
            for table, c in zip(tables[1:], packed[1:]):
                alive = alive & table[c]
            return ends[(((alive & (~alive + _ONE)) * _BRUIJN) >> _SHIFT).view(np.int64)]
        codes = layout.unpacked(packed) if codes is None else codes
        node = np.zeros(codes.shape[1], dtype=np.int64)
        rows = np.arange(len(node)) if self.left[0] >= 0 else np.zeros(0, dtype=np.int64)
        while len(rows):
            node[rows] = self.step(codes, node[rows], rows)
            rows = rows[self.left[node[rows]] >= 0]
        return node

    def masks(self, layout: Layout) -> tuple[list[np.ndarray], np.ndarray]:
        """Per group the leaves that each of its cells leaves open, and the leaf of each place of a lowest bit."""
        if self._masks is not None:
            return self._masks
        tables = [np.full(n, ~np.uint64(0)) for n in layout.cells]
        order: list[int] = []

        def walk(i: int) -> None:
            if self.left[i] < 0:
                order.append(i)
                return
            begin = len(order)
            walk(int(self.left[i]))
            gone = np.uint64(~(((1 << (len(order) - begin)) - 1) << begin) & 0xFFFFFFFFFFFFFFFF)  # leaves on the left
            walk(int(self.left[i]) + 1)
            f = int(self.feature[i])
            g, stride = layout.at[f]
            code = np.arange(layout.cells[g]) // stride % layout.sizes[f]
            tables[g][(code < self.low[i]) | (code > self.high[i])] &= gone

        walk(0)
        ends = np.zeros(64, dtype=np.int64)
        for place, i in enumerate(order):
            ends[((1 << place) * int(_BRUIJN) & 0xFFFFFFFFFFFFFFFF) >> int(_SHIFT)] = i
        self._masks = tables, ends
        return self._masks


_BRUIJN, _SHIFT, _ONE = np.uint64(0x03F79D71B4CB0A89), np.uint64(58), np.uint64(1)


@dataclass(frozen=True)
class BoostFit:
    """A fitted model: adds its prediction to any table with the raw columns."""

    encoder: Encoder
    layout: Layout
    trees: tuple
    spec: Boost
    output: str = "prediction"

    def predict(self, rows: pd.DataFrame) -> np.ndarray:
        codes = self.encoder.codes(rows)
        packed = self.layout.packed(codes)
        return sum(self.spec.weight(k) * t.value[t.leaf(self.layout, packed)] for k, t in enumerate(self.trees))

    def transform(self, df: DataFrame) -> DataFrame:
        return with_predictions(df, {self.output: self})


def with_predictions(df: DataFrame, models: dict[str, BoostFit], fold: str | None = None, by_fold: dict[str, dict[int, BoostFit]] | None = None) -> DataFrame:
    """``df`` with a prediction column per model; with ``fold``, of the model that didn't see the row's fold."""
    first = next(iter(models.values())) if models else next(iter(next(iter(by_fold.values())).values()))
    roles, names = first.encoder, list(models or by_fold)

    def run(*columns: pd.Series) -> pd.DataFrame:
        rows = pd.concat(columns, axis=1, keys=["_fold", *roles.columns])
        if models:
            return pd.DataFrame({n: m.predict(rows) for n, m in models.items()})
        out = {n: np.full(len(rows), np.nan) for n in names}
        for f in rows["_fold"].unique():
            mine = (rows["_fold"] == f).to_numpy()
            for n in names:
                out[n][mine] = by_fold[n][int(f)].predict(rows[mine])
        return pd.DataFrame(out)

    add = F.pandas_udf(run, ", ".join(f"`{n}` double" for n in names))
    x = [F.col(fold).cast("int") if fold else F.lit(0), *[F.col(c).cast("double") for c, *_ in roles.numbers], *[F.col(c).cast("string") for c, *_ in roles.levels]]
    kept = [c for c in df.columns if c not in names]
    return df.withColumn("_trees", add(*x)).select(*kept, *[F.col(f"_trees.{n}").alias(n) for n in names])


# ------------------------------------------------------------------- encoders
def _thresholds(values: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """Spark ML's thresholds of a number from its sampled values: zeros are what the expected size of the sample leaves."""
    splits = min(bins, rows) - 1
    found, counts = np.unique(values[values != 0.0], return_counts=True)
    if not len(found):
        return np.zeros(0)
    expected = _share(rows, bins) * rows
    if expected - counts.sum() > 2.220446049250313e-16 * rows * 100:
        i = int(np.searchsorted(found, 0.0))
        found, counts = np.insert(found, i, 0.0), np.insert(counts.astype(float), i, expected - counts.sum())
    if len(found) - 1 <= splits:
        return (found[:-1] + found[1:]) / 2.0
    stride = target = expected / (splits + 1)
    out, so_far = [], float(counts[0])
    for i in range(1, len(found)):
        before, so_far = so_far, so_far + float(counts[i])
        if abs(before - target) < abs(so_far - target):
            out.append((found[i - 1] + found[i]) / 2.0)
            target += stride
    return np.array(out)


def _share(rows: int, bins: int) -> float:
    return min(1.0, max(bins * bins, 10_000) / rows) if rows else 1.0


def _sampled(train: DataFrame, share: float, seed: int) -> pd.DataFrame:
    """The rows from which Spark ML's trees take thresholds: the same partitions, sampler and seed."""
    if share < 1:
        spark = train.sparkSession
        draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        rows = train._jdf.toJavaRDD().sample(False, share, draw)
        train = DataFrame(spark._jsparkSession.createDataFrame(rows, train._jdf.schema()), spark)
    return train.toPandas()


def encoders(df: DataFrame, roles: FeatureRoles, stats: dict, sizes: dict, fold: str | None, bins: int, seed: int) -> dict[int | None, Encoder]:
    """An encoder per training set; ``stats``: of ``model._training_stats``, ``sizes``: rows of each set."""
    levels = {c: tuple(sorted(stats[None][1][c])) for c in roles.categorical}
    out = {}
    for s in sizes:
        st = stats[s][0]
        train = (df if s is None else df.where(F.col(fold) != s)).select(*[F.col(c).cast("double").alias(c) for c in roles.numerical])
        sample = _sampled(train, _share(sizes[s], bins), seed) if roles.numerical else None
        numbers = []
        for c in roles.numerical:
            deviation = st.stds[c] if st.stds[c] not in (None, 0.0) else 1.0
            x = sample[c].to_numpy(dtype=float, na_value=np.nan)
            z = (np.where(sample[c].isna(), np.nan if st.medians[c] is None else st.medians[c], x) - (np.nan if st.means[c] is None else st.means[c])) / deviation
            numbers.append((c, st.medians[c], st.means[c], deviation, _thresholds(z, sizes[s], bins)))
        out[s] = Encoder(tuple(numbers), tuple((c, levels[c], st.modes[c]) for c in roles.categorical))
    return out


# --------------------------------------------------------------------- blocks
def _blocks(df: DataFrame, roles: FeatureRoles, label: str, fold: str | None, by_set: dict[int | None, Encoder], layout: Layout) -> DataFrame:
    """The table as pickled blocks, rows in order of their fold: (seed, [(fold, first, last)], labels, packed bins per set (shared where equal), predictions)."""
    columns = [F.col(fold).cast("int").alias("_fold") if fold else F.lit(-1).alias("_fold"), F.col(label).cast("double").alias("_label"),
               *[F.col(c).cast("double").alias(c) for c in roles.numerical], *[F.col(c).cast("string").alias(c) for c in roles.categorical], F.spark_partition_id().alias("_part")]

    def block(rows: pd.DataFrame, seed: tuple) -> bytes:
        if not np.isfinite(rows["_label"].to_numpy(dtype=float, na_value=np.nan)).all():
            raise ValueError("labels must be there and finite")
        rows = rows.sort_values("_fold", kind="stable")
        f = rows["_fold"].to_numpy()
        ends = [0, *(np.nonzero(np.diff(f))[0] + 1).tolist(), len(f)]
        stored, per_set = [], {}
        for s, e in by_set.items():
            per_set[s] = []
            for c in layout.packed(e.codes(rows)):
                k = next((k for k, other in enumerate(stored) if np.array_equal(other, c)), len(stored))
                if k == len(stored):
                    stored.append(c)
                per_set[s].append(k)
        parts = [(int(f[a]), a, b) for a, b in zip(ends, ends[1:]) if b > a]
        return pickle.dumps((seed, parts, rows["_label"].to_numpy(float), stored, per_set, None), protocol=5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n, k = [], 0, 0
        for batch in batches:
            waiting.append(batch)
            n += len(batch)
            if n >= _BLOCK:
                rows = pa.Table.from_batches(waiting).to_pandas()
                yield pa.RecordBatch.from_pydict({"block": [block(rows, (int(rows["_part"].iloc[0]), k))]})
                waiting, n, k = [], 0, k + 1
        if n:
            rows = pa.Table.from_batches(waiting).to_pandas()
            yield pa.RecordBatch.from_pydict({"block": [block(rows, (int(rows["_part"].iloc[0]), k))]})

    return df.select(*columns).mapInArrow(run, "block binary")


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for blob in batch.column(0):
            yield pickle.loads(blob.as_buffer())


def _drawn(spec: Boost, tree: int, seed: tuple, rows: int) -> np.ndarray | None:
    """Weights of a block's rows in a tree: 1 for those drawn; the same for every pass and set."""
    if spec.subsample >= 1:
        return None
    return (np.random.default_rng((spec.seed, tree, *seed)).random(rows) < spec.subsample).astype(float)


class Growth:
    """A model while it grows: ``base`` trees are in the blocks' predictions, the others are added up in a pass."""

    def __init__(self, held_out: int | None, spec: Boost):
        self.held_out, self.spec, self.trees, self.base, self.tree = held_out, spec, [], 0, Tree()

    @property
    def done(self) -> bool:
        return len(self.trees) >= self.spec.rounds

    def advance(self, layout: Layout, hist: np.ndarray) -> bool:
        """Whether this ends a tree."""
        self.tree.grow(layout, hist, self.spec.depth, self.spec.min_leaf)
        if len(self.tree.open):
            return False
        self.trees.append(self.tree)
        self.tree = Tree()
        return True

    def added(self, layout: Layout, packed: Sequence[np.ndarray], before: np.ndarray | None) -> np.ndarray:
        """Predictions of the trees so far."""
        out = np.zeros(len(packed[0])) if before is None else before.copy()
        for k in range(self.base, len(self.trees)):
            tree = self.trees[k]
            out += (self.spec.weight(k) * tree.value)[tree.leaf(layout, packed)]
        return out

    def target(self, y: np.ndarray, so_far: np.ndarray) -> np.ndarray:
        """What the next tree is fitted to: the label, then the negative gradient."""
        return 2.0 * (y - so_far) if self.trees else y


def _grown_in_task(held_out: int | None, spec: Boost, layout: Layout, blocks: list[tuple]) -> tuple:
    """The trees' arrays, all rows in memory."""
    parts = [(block, a, b) for block in blocks for f, a, b in block[1] if f != held_out]
    y = np.concatenate([block[2][a:b] for block, a, b in parts])
    packed = [np.concatenate([block[3][block[4][held_out][g]][a:b] for block, a, b in parts]) for g in range(len(layout.groups))]
    codes, model, so_far = layout.unpacked(packed), Growth(held_out, spec), np.zeros(len(y))
    while not model.done:
        k, tree, node = len(model.trees), model.tree, np.zeros(len(y), dtype=np.int64)
        drawn = None if spec.subsample >= 1 else np.concatenate([_drawn(spec, k, block[0], len(block[2]))[a:b] for block, a, b in parts])
        target, ended = model.target(y, so_far), False
        while not ended:
            ended = model.advance(layout, histogram(layout, packed, tree.places[node], len(tree.open), target, drawn, codes))
            rows = np.nonzero(tree.left[node] >= 0)[0]
            node[rows] = tree.step(codes, node[rows], rows)
        so_far += spec.weight(k) * tree.value[node]
    return tuple(t.arrays for t in model.trees)


def _pass(blocks: DataFrame, models: list[Growth], layout: Layout) -> dict[int, np.ndarray]:
    """Histograms of the open nodes of all models that are not done, from one scan."""
    bins = int(layout.starts[-1])
    begins = np.cumsum([0, *[len(m.tree.open) * bins for m in models]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, len(m.tree.open), bins)) for m in models]
        for seed, parts, y, stored, per_set, before in _loaded(batches):
            packed = [c.astype(np.int64) for c in stored]
            for i, (m, total) in enumerate(zip(models, sums)):
                if m.done:
                    continue
                drawn = _drawn(m.spec, len(m.trees), seed, len(y))
                places = m.tree.places
                for f, a, b in parts:
                    if f == m.held_out:
                        continue
                    mine = [packed[k][a:b] for k in per_set[m.held_out]]
                    so_far = m.added(layout, mine, None if before is None else before[i][a:b])
                    node = places[m.tree.leaf(layout, mine)] if m.tree.level else np.zeros(b - a, dtype=np.int64)
                    total += histogram(layout, mine, node, len(m.tree.open), m.target(y[a:b], so_far), None if drawn is None else drawn[a:b])
        n, s = (np.concatenate([t[k].ravel() for t in sums]) for k in (0, 1))
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_pydict({"cell": at, "n": n[at], "s": s[at]})

    found = blocks.mapInArrow(run, "cell long, n double, s double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
    whole = np.zeros((2, begins[-1]))
    at = found["cell"].to_numpy()
    whole[0, at], whole[1, at] = found["n"].to_numpy(), found["s"].to_numpy()
    return {k: whole[:, begins[k]:begins[k + 1]].reshape(2, -1, bins) for k, m in enumerate(models) if not m.done}


def _refreshed(blocks: DataFrame, models: list[Growth], layout: Layout) -> DataFrame:
    """The blocks with the predictions of the trees so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seed, parts, y, stored, per_set, before in _loaded(batches):
            after = [None if m.done else m.added(layout, [stored[k] for k in per_set[m.held_out]], None if before is None else before[i]) for i, m in enumerate(models)]
            yield pa.RecordBatch.from_pydict({"block": [pickle.dumps((seed, parts, y, stored, per_set, after), protocol=5)]})

    return blocks.mapInArrow(run, "block binary")


def _grown_in_passes(blocks: DataFrame, models: list[Growth], layout: Layout) -> None:
    """One scan of the blocks for a level of all models; only the newest blocks are kept."""
    with ExitStack() as kept:
        table = kept.enter_context(held(blocks))
        while not all(m.done for m in models):
            if min(len(m.trees) - m.base for m in models if not m.done) >= _FRESH:
                fresh = ExitStack()
                table = fresh.enter_context(held(_refreshed(table, models, layout)))
                kept.close()
                kept.push(fresh)
                for m in models:
                    m.base = len(m.trees)
            for k, hist in _pass(table, models, layout).items():
                models[k].advance(layout, hist)


def fit_boosts(df: DataFrame, roles: FeatureRoles, label: str, fold: str | None, specs: Sequence[Boost], stats: dict, bins: int = 32, seed: int = 42, local_rows: int | None = None) -> dict[tuple[int | None, Boost], BoostFit]:
    """Every spec fitted on all rows (None) and on the rows outside each fold: ``{(held-out fold, spec): model}``.

    ``df`` is scanned once for its blocks and once a training set for the
    thresholds' sample: hand in a table that is cheap to scan.
    """
    counted = {r["f"]: r["n"] for r in df.groupBy((F.col(fold).cast("int") if fold else F.lit(-1)).alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counted.values())
    sizes = {None: total} | ({f: total - n for f, n in sorted(counted.items())} if fold else {})
    if not all(sizes.values()):
        raise ValueError("no training rows")
    by_set = encoders(df, roles, stats, sizes, fold, bins, seed)
    layout = Layout(list(by_set.values()))
    todo = [(s, spec) for spec in dict.fromkeys(specs) for s in by_set]
    spark = df.sparkSession
    blocks = _blocks(df, roles, label, fold, by_set, layout)
    if total <= (LOCAL_ROWS if local_rows is None else local_rows):
        shared = spark.sparkContext.broadcast([bytes(r[0]) for r in blocks.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = [pickle.loads(b) for b in shared.value]
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_pydict({"id": [k], "trees": [pickle.dumps(_grown_in_task(*todo[k], layout, table))]})

        rows = spark.range(0, len(todo), 1, len(todo)).mapInArrow(run, "id long, trees binary").collect()
        shared.destroy()
        grown = {todo[r["id"]]: tuple(Tree.of(t) for t in pickle.loads(r["trees"])) for r in rows}
    else:
        models = [Growth(s, spec) for s, spec in todo]
        _grown_in_passes(blocks, models, layout)
        grown = {(m.held_out, m.spec): tuple(m.trees) for m in models}
    return {key: BoostFit(by_set[key[0]], layout, trees, key[1]) for key, trees in grown.items()}
