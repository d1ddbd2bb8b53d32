"""Exact duplicates by distributed MSD radix partitioning.

A document is the byte string ``length (8 bytes) || text without separators``,
so one string is never a proper prefix of another. Each round splits the open
groups by the next digit, a run of successive bytes: the digits of a group are
counted (a partial aggregate, so a group that holds a third of all rows sends
a row a task), a digit that occurs once makes its document single, and the
others go on in a group of their own until their strings have ended. Groups
are numbers given when a round is written; no digest is taken. The first digit
(length and 56 bytes) separates nearly all documents; later digits widen
16-fold, so a long copy takes few rounds, up to ``most`` bytes at a time.

A round writes one table: singles and ended documents without text, open ones
with the bytes that remain. The digits that occur more than once are broadcast
back when their bytes, counted before, are under ``MOST_BROADCAST_BYTES``, so
that no text moves. Otherwise the join is between two plain exchanges, so a hot
group is split by adaptive execution, and hashes the digits, so that no text is
sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Scratch, packed, unpacked, without_spaces

MOST_BROADCAST_BYTES = 32 << 20
NEW = ["keep_id", "group_size", "kept"]


def radix_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", first: int = 64, most: int = 1 << 20,
                keep_columns: list[str] | None = None, most_broadcast: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """The input columns (or ``keep_columns`` of them) with ``keep_id``, ``group_size`` and ``kept``, one row per input row.

    Texts are equal when the same after deleting ``[\\x20\\x09-\\x0D]``; null is
    empty, and empty texts equal each other. Of equal texts the row with the
    most code points in its original text stays, then the smallest ``doc_id``
    (null last); of rows that repeat even that, exactly one. ``keep_id`` is
    the ``doc_id`` of the row that stays. An empty table gives an empty
    result. An input column named like a new one gives way to it.
    """
    columns = docs.columns if keep_columns is None else keep_columns
    spark = docs.sparkSession
    scratch = Scratch(spark, "radix")
    body = F.encode(without_spaces(F.col(text)), "UTF-8")
    active = docs.select(
        packed(docs, columns).alias("_row"), F.col(doc_id).alias("_id"),
        F.coalesce(F.char_length(text), F.lit(0)).alias("_cp"), F.lit(0).cast("long").alias("_gid"),
        F.concat(F.unhex(F.lpad(F.hex(F.octet_length(body).cast("long")), 16, "0")), body).alias("_rest"))
    done, width, number, held = [], first, 0, None
    while True:
        digit = F.substring(F.col("_rest"), 1, width)
        groups, groups_path = scratch.write(
            active.groupBy("_gid", digit.alias("_digit")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
            .select(F.col("_gid").alias("_g"), F.col("_digit").alias("_d"), F.monotonically_increasing_id().alias("_new")), "groups")
        size = groups.agg(F.sum(F.octet_length("_d") + 48)).first()[0] or 0
        ended = F.octet_length("_rest") <= width
        round_, path = scratch.write(
            active.join(groups.hint("broadcast" if size <= most_broadcast else "shuffle_hash"), (F.col("_gid") == F.col("_g")) & (digit == F.col("_d")), "left")
            .select("_row", "_id", "_cp", F.lit(number).alias("_round"), F.col("_new").alias("_gid"),
                    F.when(F.col("_new").isNull(), "single").when(ended, "equal").otherwise("open").alias("_state"),
                    F.when(F.col("_new").isNotNull() & ~ended, F.substring(F.col("_rest"), F.lit(width + 1), F.lit(2**31 - 1))).alias("_rest"),
                    F.monotonically_increasing_id().alias("_tag")), "round")
        scratch.drop(groups_path)
        done.append(round_.where("_state != 'open'").drop("_rest"))
        active = round_.where("_state = 'open'").select("_row", "_id", "_cp", "_gid", "_rest")
        if active.isEmpty():
            break
        number, width = number + 1, min(width * 16, most)
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    equal = rows.where("_state = 'equal'")
    order = F.struct((-F.col("_cp")).alias("cp"), F.col("_id").isNull().alias("null"), F.col("_id").alias("id"), F.col("_tag").alias("tag"))
    best = scratch.table(equal.groupBy(F.col("_round").alias("_r"), F.col("_gid").alias("_g"))
                         .agg(F.min(order).alias("_best"), F.count(F.lit(1)).alias("_n")), "best")
    out = unpacked("_row", columns, NEW)
    alone = rows.where("_state = 'single'").select(*out, F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    copies = (equal.join(best, (F.col("_round") == F.col("_r")) & (F.col("_gid") == F.col("_g")))
              .select(*out, F.col("_best.id").alias("keep_id"), F.col("_n").alias("group_size"), (F.col("_tag") == F.col("_best.tag")).alias("kept")))
    return alone.unionByName(copies)
