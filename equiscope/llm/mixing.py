"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are laid on a line of its words in an order drawn by a
hash; a second pass lays them again. The source's target is a place on that
line, and a copy of a document is drawn when its middle lies before it, so the
words taken differ from the target by half a document at most. The line up to
the target is cut into the source's quota of blocks of equal length.

The blocks of all sources fill output shards of equal block counts. A node of
the tree holds the block count of each source; its left child's counts are
drawn from the multivariate hypergeometric distribution (each block in turn
goes left with probability left places / places), the right child keeps the
rest, so quotas are met exactly at every level. A leaf's counts of a source
take that many blocks in a permuted order, no block twice. Inside a shard,
copies are shuffled by a hash.

All steps are DataFrame operations. What grows with the rows: one aggregate by
source (partial), one distributed running total by (source, permuted order),
so a hot source spans many tasks; neither carries the texts. The tree and the
borders of the blocks work on ``blocks`` + number of sources rows; a document
finds its blocks by the borders, without a shuffle, so its text is shuffled
with its copies alone. All draws are hashes of ``seed``, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.prefix import running_totals
from .util import Scratch, packed, unpacked, word_count

NEW = ["size", "source_size", "target", "taken", "shards"]


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Of (``source``, ``source_size``): + ``place`` (from 0, by code point, null last), ``weight``, ``target``.

    Weights repeat along the places. ``share`` times all sizes is dealt by
    weight; a source stops at ``cap`` times its size and the excess is dealt
    again: in the order of cap / weight, sources are full as long as their cap
    is below what the level of the rest would give them.
    """
    by_name, everywhere = W.orderBy(F.col("source").asc_nulls_last()), W.partitionBy()
    before = W.orderBy(F.col("most") / F.col("weight"), "place").rowsBetween(W.unboundedPreceding, -1)
    s = (sizes.withColumn("place", F.row_number().over(by_name) - 1)
         .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
         .withColumn("most", F.col("source_size") * F.lit(float(cap))))
    level = ((F.sum("source_size").over(everywhere) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("level", level).withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    last = F.max(F.when(~F.col("full"), F.col("level"))).over(everywhere)
    return (s.withColumn("target", F.round(F.when(F.col("full"), F.col("most")).otherwise(last * F.col("weight")), 6))
            .select("source", "source_size", "place", "weight", "target"))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Of (``place`` = 0, 1, ..., ``quota``): (``place``, ``shard``, ``n``), the tree's leaves. ``shards`` is a power of two."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards is a power of two")
    nodes = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "quota"))), lambda x: x["quota"]).alias("counts")).withColumn("shard", F.lit(0))
    for level in range(shards.bit_length() - 1):
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, q: a + q)

        def draw(acc: Column, quota: Column) -> Column:
            index = F.size(acc["out"])
            chance = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("shard"), index, k), F.lit(1 << 40)) / F.lit(float(1 << 40))  # noqa: B023, E731
            went = F.aggregate(
                F.when(quota > 0, F.sequence(F.lit(1).cast("long"), quota)).otherwise(F.array().cast("array<long>")),
                F.struct(acc["left"].alias("left"), acc["all"].alias("all")),
                lambda s, k: F.struct((s["left"] - F.when(chance(k) * s["all"] < s["left"], 1).otherwise(0)).cast("long").alias("left"), (s["all"] - 1).alias("all")))
            return F.struct(went["left"].alias("left"), went["all"].alias("all"),
                            F.concat(acc["out"], F.array(acc["left"] - went["left"])).alias("out"))

        start = F.struct(F.floor(total / 2).cast("long").alias("left"), total.alias("all"), F.array().cast("array<long>").alias("out"))
        nodes = nodes.withColumn("lefts", F.aggregate("counts", start, draw, lambda a: a["out"]))
        rights = F.zip_with("counts", "lefts", lambda a, b: a - b)
        nodes = nodes.select(F.explode(F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("lefts").alias("counts")),
                                               F.struct((F.col("shard") * 2 + 1).alias("shard"), rights.alias("counts")))).alias("node")).select("node.*")
    return nodes.select("shard", F.posexplode("counts").alias("place", "n")).where("n > 0")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = (5, 2, 1),
        share: float = 1.5, cap: float = 2.0, shards: int = 64, blocks: int = 4096, seed: int = 20, keep_columns: list[str] | None = None) -> DataFrame:
    """One row per input row: its columns, ``size``, ``source_size``, ``target``, ``taken`` and ``shards`` (one entry per copy drawn: 0, 1 or 2).

    Size is the number of words (null text: 0). A null source is a source,
    placed last. Targets are at most ``cap`` (2 at most) times the source's
    size, so no row is drawn more than twice. Rows without words take no
    words; they are drawn with their place on the line. Repeated rows are
    drawn each on its own. An empty table gives an empty result. An input
    column named like a new one gives way to it.
    """
    if cap > 2:
        raise ValueError("two passes give at most twice a source")
    columns = docs.columns if keep_columns is None else keep_columns
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.table(docs.select(packed(docs, columns).alias("_row"), F.col(doc_id).alias("_id"), F.col(source).cast("string").alias("source"),
                                     word_count(F.col(text)).alias("size"), F.monotonically_increasing_id().alias("_tag")), "rows")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    each = F.sum("target").over(W.partitionBy()) / F.lit(float(blocks))
    plan = scratch.table(plan.withColumn("quota", F.when(F.col("target") > 0, F.greatest(F.lit(1), F.round(F.col("target") / each))).otherwise(0).cast("long")), "plan")
    leaves = split_quotas(plan.select("place", "quota"), shards, seed)
    first = F.coalesce(F.sum("n").over(W.partitionBy("place").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    leaves = leaves.withColumn("first", first).select("place", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("turn"))
    drawn = plan.where("quota > 0").select("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("block"))
    turn = F.row_number().over(W.partitionBy("place").orderBy(F.xxhash64(F.lit(seed), F.lit("block"), "place", "block"), "block")) - 1
    placed = scratch.table(drawn.withColumn("turn", turn.cast("long")).join(leaves, ["place", "turn"]).select("place", "block", "shard"), "placed")

    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    line = running_totals(rows.select("source", "size", "_tag", order.alias("_order")), ["source"], ["_order", "_tag"], ["size"], ["_end"])
    line = line.join(plan.select(F.col("source").alias("_s"), "source_size", "target", "place", "quota"), F.col("source").eqNullSafe(F.col("_s")))

    def block(again: int) -> Column:
        start = F.col("_end") - F.col("size") + again * F.col("source_size")
        return F.when(start + F.col("size") / 2 < F.col("target"), F.least(F.floor(start / F.col("target") * F.col("quota")), F.col("quota") - 1).cast("long"))

    marks = borders(line.select("place", "quota", "_order", "_tag", F.posexplode(F.array(block(0), block(1))).alias("pass", "block")), placed)
    marks = scratch.table(marks, "borders")
    rows = rows.withColumn("_order", order)
    rows = rows.join(plan.select(F.col("source").alias("_s"), "source_size", "target", "place", "quota"), F.col("source").eqNullSafe(F.col("_s")))
    rows = rows.withColumn("_cell", cell(F.col("_order"), F.col("quota"))).join(marks.withColumnsRenamed({"place": "_p", "cell": "_c"}), (F.col("place") == F.col("_p")) & (F.col("_cell") == F.col("_c")))
    here = F.struct(F.col("_order").alias("order"), F.col("_tag").alias("tag"))
    shard = lambda i: F.element_at(F.filter(f"marks{i}", lambda m: m["key"] <= here), -1)["shard"]
    return rows.withColumn("shards", F.array_compact(F.array(shard(0), shard(1)))).select(
        *unpacked("_row", columns, NEW), "size", "source_size", "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"), "shards")


def cell(order: Column, quota: Column) -> Column:
    """Which of a source's cells, one a block of its quota and one at least, the hexadecimal ``order`` falls into: they rise together."""
    return F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * F.greatest(quota, F.lit(1)) / F.lit(float(1 << 32))).cast("long")


def borders(line: DataFrame, placed: DataFrame) -> DataFrame:
    """Where on the lines blocks begin: a row per (``place``, ``cell``), with ``marks0`` and ``marks1`` for the two passes.

    ``line`` has a row per document and pass: ``place``, ``quota``, ``_order``,
    ``_tag``, ``pass``, ``block`` (null: not drawn). Blocks rise with
    (``_order``, ``_tag``), and the rows not drawn come last, so a row's block
    is that of the last mark (``key``, ``shard``) not behind it. A cell's list
    begins with the mark in force where the cell begins. At most two marks a
    block and cells as many as blocks, however many documents there are.
    """
    first = line.groupBy("place", "quota", "pass", "block").agg(F.min(F.struct(F.col("_order").alias("order"), F.col("_tag").alias("tag"))).alias("key"))
    first = first.join(placed.withColumnsRenamed({"place": "_p", "block": "_b"}), (F.col("place") == F.col("_p")) & (F.col("block") == F.col("_b")), "left")
    mark = F.struct("key", "shard")
    held = first.groupBy("place", "quota", cell(F.col("key.order"), F.col("quota")).alias("cell")).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("pass") == i, mark))).alias(f"own{i}") for i in (0, 1)])
    cells = held.select("place", "quota").distinct().select("place", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("quota", F.lit(1)) - 1)).alias("cell"))
    cells = cells.join(held.drop("quota"), ["place", "cell"], "left")
    before = W.partitionBy("place").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    for i in (0, 1):
        own = F.col(f"own{i}")
        last = F.last(F.when(F.size(own) > 0, F.element_at(own, -1)), ignorenulls=True).over(before)
        cells = cells.withColumn(f"marks{i}", F.array_compact(F.concat(F.array(last), F.coalesce(own, F.array().cast(held.schema[f"own{i}"].dataType)))))
    return cells.select("place", "cell", "marks0", "marks1")


def drawn_copies(mixed: DataFrame, doc_id: str = "doc_id", slices: int = 16, seed: int = 20) -> DataFrame:
    """A row per copy, dealt by (shard, slice) and shuffled inside: ``shards`` gives way to ``shard``."""
    rows = mixed.select(*[F.col(f"`{c}`") for c in mixed.columns if c not in ("shards", "shard")], F.posexplode("shards").alias("_copy", "shard"))
    rows = rows.withColumn("_turn", F.xxhash64(F.lit(seed), F.lit("turn"), "shard", doc_id, "_copy")).withColumn("_slice", F.pmod("_turn", F.lit(slices)))
    return rows.repartition("shard", "_slice").sortWithinPartitions("shard", "_slice", "_turn").drop("_copy", "_turn", "_slice")
