"""Sharding by a minimax contiguous partition of ordered atomic groups.

Groups (equal texts) stay whole and keep their order (by least id). The
smallest capacity at which a greedy filling needs no more than the given
shards is searched, and the shards are cut where that filling cuts. Group
sizes are prefix sums made by a distributed running total. The greedy check
fills shard after shard: the next cut is the greatest prefix sum not above
the last cut plus the capacity, an aggregate over the groups between. The
search tries ``WAYS`` capacities in a pass, so it takes
log_WAYS(largest group) x shards passes over a narrow table that is stored
in order, of which a pass reads the part between its bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import running_totals
from .util import Scratch, packed, unpacked

WAYS = 32
NEW = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def greedy_cuts(prefix: DataFrame, capacities: list[int], shards: int) -> list[list[int]]:
    """For each capacity, the places (prefix sums) at which the greedy filling cuts."""
    cuts: list[list[int]] = [[] for _ in capacities]
    for _ in range(shards):
        limits = [(c[-1] if c else 0) + size for c, size in zip(cuts, capacities)]
        near = prefix.where(F.col("cum").between(min(c[-1] if c else 0 for c in cuts), max(limits)))
        at = near.agg(*[F.max(F.when(F.col("cum") <= limit, F.col("cum"))).alias(f"c{i}") for i, limit in enumerate(limits)]).first()
        for c, found in zip(cuts, at):
            c.append(max(found or 0, c[-1] if c else 0))
    return cuts


def minimax_cuts(prefix: DataFrame, total: int, largest: int, shards: int, ways: int = WAYS) -> list[int]:
    """Cuts of the smallest capacity that ``shards`` shards of whole groups need."""
    low = max(largest, -(-total // shards))  # smallest that may do
    high = -(-total // shards) + largest  # does
    best = None
    while best is None or low < high:
        tried = sorted({low + (high - low) * i // ways for i in range(ways)} | {high})
        fill = greedy_cuts(prefix, tried, shards)
        at = next(i for i, cuts in enumerate(fill) if cuts[-1] == total)
        best, high = fill[at], tried[at]
        low = tried[at - 1] + 1 if at else tried[at]
    return best


def minimax_shards(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = 8, keep_columns: list[str] | None = None) -> DataFrame:
    """The input columns with ``size``, ``text_crc32``, ``law`` ("bytes"), ``shard``, ``slot`` and ``grown_shard`` (null).

    Size: UTF-8 bytes of the text (null: none) plus 1. Null and empty texts
    are one group. Rows with the same ``doc_id`` or wholly repeated rows each
    have a slot of their own. Slots of a shard are gapless from 0, in the
    order of the groups and then of ``doc_id`` (null first). Shards may be
    empty when groups are few. An empty table gives an empty result. An input
    column named like a new one gives way to it.
    """
    columns = docs.columns if keep_columns is None else keep_columns
    scratch = Scratch(docs.sparkSession, "shards")
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = scratch.table(docs.select(packed(docs, columns).alias("_row"), F.col(doc_id).alias("_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
                                     F.crc32(body).alias("crc"), F.unhex(F.sha2(body, 256)).alias("digest"), F.monotonically_increasing_id().alias("_tag")), "rows")
    groups = scratch.table(rows.groupBy("digest").agg(F.min("_id").alias("first"), F.sum("size").alias("bytes"), F.max("size").alias("one")), "groups")
    n, total, largest = groups.agg(F.count(F.lit(1)), F.sum("bytes"), F.max("bytes")).first()
    prefix = groups.select("digest", "first", "bytes")
    if n:
        prefix = scratch.table(running_totals(prefix, [], ["first", "digest"], ["bytes"], ["cum"], rows=n), "prefix")
        cuts = minimax_cuts(prefix.select("cum"), total, largest, shards)
    else:
        prefix, cuts = prefix.withColumn("cum", F.lit(0).cast("long")), [0]
    place = F.lit(0)
    for cut in cuts[:-1]:
        place = place + (F.col("cum") > cut).cast("int")
    placed = scratch.table(prefix.select(F.col("digest").alias("_d"), "cum", place.alias("shard")), "placed")
    sharded = (rows.join(placed, F.col("digest") == F.col("_d"))
               .select("_row", "_id", "size", "crc", "cum", "shard", "_tag", F.lit(1).cast("long").alias("_one")))
    slotted = running_totals(sharded.drop("_row"), ["shard"], ["cum", "_id", "_tag"], ["_one"], ["_slot"], key_count=shards)
    slotted = scratch.table(slotted.select(F.col("_tag").alias("_t"), F.col("shard"), (F.col("_slot") - 1).alias("slot")), "slots")
    return rows.join(slotted, F.col("_tag") == F.col("_t")).select(
        *unpacked("_row", columns, NEW), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
