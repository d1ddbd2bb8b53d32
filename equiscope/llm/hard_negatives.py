"""Hard negatives by rotated one-bit codes with exact intervals.

1. **Codes.** Vectors become integers and are centred at the integer mean c.
   What remains is rotated by a fixed random rotation and replaced by its signs
   times their alignment with it (a stored number); the residual is rotated and
   coded again, ``LEVELS`` times. 64 signs are a word.
2. **Estimates.** An anchor's rotated vector is rounded to ``PLANES`` bits, so
   its product with a code is a few popcounts. The rounding is bounded by the
   sum of its errors, what the codes leave out by Cauchy-Schwarz: anchor's norm
   times the stored norm of the last residual (at the first level the parts
   along the code are taken off both). So each row has an interval that holds
   its score for certain.
3. **Positives.** Rows of the anchor's label whose interval reaches the k-th
   best score so far are scored in integers.
4. **Negatives.** Rows of other labels whose interval meets the window of one
   of the anchor's positives, and reaches the k-th best there, likewise.

Anchors and rows meet as packed blocks: a task has a bounded run of anchors and
streams a bounded group of rows past them, holding one block at a time, and
returns the best k of its group only. Each row travels once per run of anchors,
each anchor once per group of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .util import Scratch, arrow_rows

LEVELS, PLANES, BLOCK, GROUP, RUN = 4, 6, 4096, 1 << 17, 8192
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def rotations(width: int, seed: int = 5) -> list:
    """A random rotation per level, the same everywhere."""
    import numpy as np

    rng = np.random.default_rng(seed)
    return [np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(LEVELS)]


def words(bits):
    """Rows of booleans as rows of 64-bit words."""
    import numpy as np

    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view("<u8")


class Codes:
    """One-bit codes of rows: words of signs and alignment per level, norm of the last residual."""

    def __init__(self, signs, aligned, rest, norm):
        self.signs, self.aligned, self.rest, self.norm = signs, aligned, rest, norm

    @classmethod
    def of(cls, y, turns) -> Codes:
        import numpy as np

        z, root = y.astype(float), math.sqrt(y.shape[1])
        norm, signs, aligned = np.linalg.norm(z, axis=1), [], []
        for turn in turns:
            z = z @ turn
            up = z >= 0
            signs.append(words(up))
            aligned.append(np.abs(z).sum(1) / root)
            z = z - np.where(up, 1.0, -1.0) * (aligned[-1] / root)[:, None]
        return cls(np.stack(signs), np.stack(aligned), np.linalg.norm(z, axis=1), norm)

    def interval(self, asked: Asked, rows):
        """(low, high) of the product with the anchor, for certain."""
        import numpy as np

        middle, slack = 0.0, 0.0
        for level, (low, step, total, planes, off) in enumerate(asked.levels):
            signs = self.signs[level][rows]
            inside = low * np.bitwise_count(signs).sum(1, dtype=np.int64)
            for bit, plane in enumerate(planes):
                inside = inside + step * (1 << bit) * np.bitwise_count(signs & plane).sum(1, dtype=np.int64)
            along = (2 * inside - total) / asked.root  # the rounded anchor's product with the unit code
            aligned = self.aligned[level][rows]
            middle, slack = middle + aligned * along, slack + aligned * off
            if level == 0:
                least = np.maximum(np.abs(along) - off, 0.0)
                across = np.sqrt(np.maximum(asked.norm ** 2 - least ** 2, 0.0)) * np.sqrt(np.maximum(self.norm[rows] ** 2 - aligned ** 2, 0.0))
                first = middle - slack - across, middle + slack + across
        slack = slack + asked.norm * self.rest[rows]
        spare = 1e-9 * (1.0 + asked.norm * self.norm[rows])  # rounding of doubles
        return np.maximum(middle - slack, first[0]) - spare, np.minimum(middle + slack, first[1]) + spare


class Asked:
    """An anchor's rotated vector per level, rounded to ``PLANES`` bits."""

    def __init__(self, y, turns):
        import numpy as np

        z, self.levels, self.root, self.norm = y.astype(float), [], math.sqrt(len(y)), float(np.linalg.norm(y))
        for turn in turns:
            z = z @ turn
            low = float(z.min())
            step = max((float(z.max()) - low) / ((1 << PLANES) - 1), 1e-300)
            u = np.rint((z - low) / step).astype(np.int64)
            off = float(np.abs(z - (low + step * u)).sum()) / self.root
            self.levels.append((low, step, float((low + step * u).sum()), [words((u >> bit & 1).astype(bool)[None, :])[0] for bit in range(PLANES)], off))


def usable(df: DataFrame, vector: str, vec_id: str, label: str, scale: int) -> DataFrame:
    """(``id``, ``label``, ``v`` as integers) of the rows that take part, wholly repeated ones once."""
    v = F.col("v")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < (1 << 31) / scale)
    return (df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, finite), F.lit(False)))
            .withColumn("v", F.transform(v, lambda x: F.floor(x * scale).cast("int"))).distinct())


def mine(df: DataFrame, is_anchor: Column, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", positives: int = 5, negatives: int = 10,
         least: int = 30, most: int = 90, scale: int = 256) -> DataFrame:
    """Per anchor (``is_anchor``, a condition on ``id``) and positive the first negatives: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    An entry x becomes floor(scale * x); scores are inner products of these
    integers, higher first, ties by smaller id. Positives are the first
    ``positives`` rows of the anchor's label under another id; negatives the
    first ``negatives`` rows of other labels with least * positive_score <=
    100 * negative_score <= most * positive_score. Null ids, labels and vectors
    take no part, nor do empty vectors, null or non-finite entries, vectors of
    another length than the most frequent one (ties: the shortest), and entries
    so large that scores may not fit a long (beyond the root of 2^62 / width).
    Wholly repeated rows count once; rows that share an id with another label
    or vector each count. An empty table, or one without anchors, gives an
    empty result. Other columns are not looked at.
    """
    import numpy as np

    spark = df.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = usable(df, vector, vec_id, label, scale)
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], RESULT)
    width = lengths[0]["n"]
    largest = min((1 << 31) - 1, math.isqrt((1 << 62) // width))
    rows = rows.where((F.size("v") == width) & F.forall("v", lambda x: F.abs(x.cast("long")) <= largest))
    rows, rows_path = scratch.write(rows.withColumn("tag", F.monotonically_increasing_id()), "rows")
    sums = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    anchors = rows.where(is_anchor)
    asking = anchors.count()
    if not asking:
        return spark.createDataFrame([], RESULT)
    total, centre = sums[0]["n"], np.zeros(width, np.int64)
    for r in sums:
        centre[r["at"]] = round(r["m"])
    turns = rotations(width)
    groups = -(-total // GROUP)
    run = min(RUN, max(32, -(-asking // spark.sparkContext.defaultParallelism)))
    runs = -(-asking // run)

    def vectors(column):
        return np.ascontiguousarray(column.flatten().to_numpy()).reshape(-1, width).astype(np.int64)

    def chunks(batches: Iterator[pa.RecordBatch], most_rows: int) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most_rows):
                held.append(batch.slice(at, most_rows))
                n += held[-1].num_rows
                if n >= most_rows:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, BLOCK):
            v = vectors(t["v"].chunk(0))
            codes = Codes.of(v - centre, turns)
            parts = [t["id"].to_numpy(), t["label"].to_numpy(), t["tag"].to_numpy(), v.astype("<i4"), codes.signs, codes.aligned, codes.rest, codes.norm]
            yield pa.RecordBatch.from_arrays([pa.array([int(parts[2][0])]), pa.array([t.num_rows], pa.int32()), *[pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts]],
                                             ["block", "n", "ids", "labels", "tags", "v", "signs", "aligned", "rest", "norm"])

    columns = ["ids", "labels", "tags", "v", "signs", "aligned", "rest", "norm"]
    packs = scratch.table(rows.repartition(max(1, -(-total // BLOCK)), "tag").mapInArrow(packed, "block long, n int, " + ", ".join(f"{c} binary" for c in columns)), "blocks")

    def searched(asked: DataFrame, take, schema: str) -> DataFrame:
        """``take(anchor, state, block)`` over every block of a task's group, then what the anchors' states hold. ``asked``: id, label, tag, v, positives."""
        line = pa.schema([pa.field(f.name, t) for f, t in zip(spark.createDataFrame([], schema).schema, [pa.int64()] * 99)])

        def run_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held = None, []

            def finished():
                made = [row for anchor, state in held for row in state.rows(anchor)]
                return [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made)], schema=line)] if made else []

            for batch in batches:
                for r in batch.to_pylist():
                    if (r["run"], r["grp"]) != key:
                        yield from finished()
                        key, held = (r["run"], r["grp"]), []
                    if r["anchor"] is not None:
                        held.append((Anchor(r["anchor"], centre, turns), State()))
                        continue
                    block = Block(r["block"], width)
                    for anchor, state in held:
                        take(anchor, state, block)
            yield from finished()

        anchor, block = F.struct("id", "label", "tag", "v", "positives"), F.struct("n", *columns)
        left = asked.select(F.pmod(F.xxhash64("tag"), F.lit(runs)).cast("int").alias("run"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(None).cast("long").alias("at"), anchor.alias("anchor"))
        right = packs.select(F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("grp"), F.col("block").alias("at"), block.alias("block"))
        tasks = left.unionByName(right, allowMissingColumns=True).repartition(2 * runs * groups, "run", "grp").sortWithinPartitions("run", "grp", F.col("at").asc_nulls_first())
        with arrow_rows(spark, 16):  # a row holds a block
            return scratch.table(tasks.mapInArrow(run_tasks, schema), "found")

    def same_label(anchor: Anchor, state: State, block: Block) -> None:
        rows = np.flatnonzero((block.labels == anchor.label) & (block.ids != anchor.id))
        if not len(rows):
            return
        low, high = block.interval(anchor, rows)
        floor = state.floor(None, positives)
        if len(rows) > positives:
            floor = max(floor, -np.partition(-low, positives - 1)[positives - 1])
        near = np.flatnonzero(high >= floor)
        for some in (near[np.argsort(-(low + high)[near], kind="stable")[:4 * positives]], near):  # the likeliest raise the floor for the others
            some = some[high[some] >= max(floor, state.floor(None, positives))]
            state.add(None, block, rows[some], block.scores(anchor, rows[some]), positives)

    def other_label(anchor: Anchor, state: State, block: Block) -> None:
        rows = np.flatnonzero(block.labels != anchor.label)
        if not len(rows):
            return
        low, high = block.interval(anchor, rows)
        for some in (np.argsort(-(low + high), kind="stable")[:4 * negatives], slice(None)):
            at = np.arange(len(rows))[some]
            wanted = [(100 * high[at] >= least * p[2]) & (100 * low[at] <= most * p[2]) & (high[at] >= state.floor(i, negatives)) for i, p in enumerate(anchor.positives)]
            at = at[np.logical_or.reduce(wanted)]
            score = block.scores(anchor, rows[at])
            for i, (_, _, positive) in enumerate(anchor.positives):
                # in whole numbers: least * positive <= 100 * score <= most * positive
                fits = np.flatnonzero((score >= -(-least * positive // 100)) & (score <= most * positive // 100) & (score >= state.floor(i, negatives)))
                state.add(i, block, rows[at[fits]], score[fits], negatives)

    first = F.row_number().over
    none = F.array().cast("array<struct<id:long,tag:long,score:long>>").alias("positives")
    found = searched(anchors.select("id", "label", "tag", "v", none), same_label, "tag long, slot long, id2 long, tag2 long, score long")
    found = found.withColumn("_r", first(W.partitionBy("tag").orderBy(F.desc("score"), "id2", "tag2"))).where(F.col("_r") <= positives)
    chosen = scratch.table(found.groupBy(F.col("tag").alias("_tag")).agg(F.sort_array(F.collect_list(F.struct("_r", F.col("id2").alias("id"), F.col("tag2").alias("tag"), "score"))).alias("_p")), "positives")
    positive = F.transform("_p", lambda p: F.struct(p["id"].alias("id"), p["tag"].alias("tag"), p["score"].alias("score"))).alias("positives")
    asked = anchors.join(chosen, F.col("tag") == F.col("_tag")).select("id", "label", "tag", "v", positive)
    found = searched(asked, other_label, "tag long, slot long, id2 long, tag2 long, score long")
    found = found.withColumn("rank", first(W.partitionBy("tag", "slot").orderBy(F.desc("score"), "id2", "tag2"))).where(F.col("rank") <= negatives)
    named = anchors.select(F.col("id").alias("anchor_id"), F.col("tag").alias("_t")).join(chosen, F.col("_t") == F.col("_tag"))
    named = named.select("anchor_id", "_t", F.posexplode("_p").alias("_slot", "_p"))
    out = found.join(named, (F.col("tag") == F.col("_t")) & (F.col("slot") == F.col("_slot")))
    return out.select("anchor_id", F.col("_p.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id2").alias("negative_id"),
                      F.col("_p.score").alias("positive_score"), F.col("score").alias("negative_score"))


class Anchor:
    """An anchor in a task: its integers, its rounded rotations, and its positives as (id, tag, score)."""

    def __init__(self, row: dict, centre, turns):
        import numpy as np

        self.id, self.label, self.tag, self.v = row["id"], row["label"], row["tag"], np.array(row["v"], np.int64)
        self.positives = [(p["id"], p["tag"], p["score"]) for p in row["positives"]]
        self.asked = Asked(self.v - centre, turns)
        self.centre = centre
        self.along_centre = int(self.v @ centre)


class Block:
    """A packed block of rows."""

    def __init__(self, row: dict, width: int):
        import numpy as np

        n = row["n"]
        of = lambda name, kind, *shape: np.frombuffer(row[name], kind).reshape(*shape)
        self.ids, self.labels, self.tags = of("ids", "<i8", n), of("labels", "<i8", n), of("tags", "<i8", n)
        self.v = of("v", "<i4", n, width)
        self.codes = Codes(of("signs", "<u8", LEVELS, n, -1), of("aligned", "<f8", LEVELS, n), of("rest", "<f8", n), of("norm", "<f8", n))

    def interval(self, anchor: Anchor, rows):
        """Bounds of the score: of the centred vectors' product, moved by the exact products with the centre."""
        if not hasattr(self, "along"):
            self.along = (self.v.astype("int64") - anchor.centre) @ anchor.centre
        low, high = self.codes.interval(anchor.asked, rows)
        moved = (self.along[rows] + anchor.along_centre).astype(float)
        spare = 1e-12 * abs(moved)
        return low + moved - spare, high + moved + spare

    def scores(self, anchor: Anchor, rows):
        return self.v[rows].astype("int64") @ anchor.v


class State:
    """The best rows so far per slot: (score, id, tag)."""

    def __init__(self):
        self.held: dict = {}

    def floor(self, slot, k: int) -> float:
        held = self.held.get(slot)
        return -math.inf if held is None or len(held[0]) < k else float(held[0][-1])

    def add(self, slot, block: Block, rows, score, k: int) -> None:
        import numpy as np

        if len(rows):
            new = score, block.ids[rows], block.tags[rows]
            old = self.held.get(slot)
            score, ids, tags = new if old is None else (np.r_[a, b] for a, b in zip(old, new))
            tags, place = np.unique(tags, return_index=True)  # a row may be scored twice
            score, ids = score[place], ids[place]
            at = np.lexsort((tags, ids, -score))[:k]
            self.held[slot] = score[at], ids[at], tags[at]

    def rows(self, anchor: Anchor):
        for slot, held in self.held.items():
            for score, i, tag in zip(*held):
                yield anchor.tag, -1 if slot is None else slot, int(i), int(tag), int(score)
