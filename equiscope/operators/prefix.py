"""Exact running totals in a global order, spread over as many tasks as the data needs.

A window ``sum(...) OVER (PARTITION BY key ORDER BY x)`` runs each key in one
task, and a window without PARTITION BY runs the whole table in one task.
Here the order is cut into contiguous ranges instead:

1. ``repartitionByRange`` (sampled bounds, binary search per row, all on the
   JVM) splits the rows into ``parts`` ranges of (keys, order), with
   ``parts`` at least the session's shuffle width and grown from the row
   count so a range holds about ``rows_per_task`` rows; a hot key spans many
   ranges;
2. the range id is stored with the rows and the table is written to the
   shared checkpoint folder, so both passes below see one fixed assignment
   even if executors are lost and stages re-run;
3. per (key, range) totals — at most ``parts`` + #keys rows — give each
   range its exclusive offset (a window over that small table, broadcast back
   when its counted size is under ``BROADCAST_ROWS``);
4. a window inside (key, range) adds the local running sum to the offset.

The order columns must be a total order within a key for the result to be
deterministic (callers aggregate to distinct values or add tie-breakers).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

ROWS_PER_TASK = 1_000_000
BROADCAST_ROWS = 1_000_000  # offsets table rows up to which it is broadcast


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str],
                   out: Sequence[str] | None = None, rows: int | None = None,
                   rows_per_task: int = ROWS_PER_TASK,
                   how: str = "sum", key_count: int | None = None) -> DataFrame:
    """``df`` plus inclusive running sums (``how="sum"``) or running maxima
    (``how="max"``, NULLs ignored) of ``sums`` per ``keys`` in ``order``.

    ``rows`` (the row count of ``df``) may be passed when already known;
    otherwise it is counted. ``key_count`` (the number of distinct keys, when
    the caller knows it) bounds the offsets table without counting it. The result is read from files and can be
    used by several actions.
    """
    from ..session import written

    if how not in ("sum", "max"):
        raise ValueError("how must be 'sum' or 'max'")
    agg = F.sum if how == "sum" else F.max
    keys, order, sums = list(keys), list(order), list(sums)
    out = list(out) if out is not None else [f"cum_{c}" for c in sums]
    n = rows if rows is not None else df.count()
    # at least the session's shuffle width (so small inputs still use every
    # core), more when the data needs it; never more ranges than rows
    floor_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = max(1, min(max(n, 1), max(floor_parts, math.ceil(n / rows_per_task))))
    ranged = written(df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in keys + order])
                     .withColumn("_pid", F.spark_partition_id()))
    tot = ranged.groupBy(*keys, "_pid").agg(*[agg(c).alias(f"_t{i}") for i, c in enumerate(sums)])
    wo = W.partitionBy(*keys).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offs = tot.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], F.col("_pid").alias("_opid"),
                      *[(F.coalesce(F.sum(f"_t{i}").over(wo), F.lit(0)) if how == "sum"
                         else F.max(f"_t{i}").over(wo)).alias(f"_o{i}")
                        for i in range(len(sums))])
    cond = [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)] + [F.col("_pid") == F.col("_opid")]
    wl = W.partitionBy(*keys, "_pid").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    # one row per (key, range): ≤ parts + #keys rows. Broadcast only when that
    # count, read from the small aggregate, is under the bound; else a shuffle join.
    if not keys:
        n_offs = parts  # one row per range
    elif key_count is not None:
        n_offs = parts + key_count
    else:
        n_offs = tot.count()
    return (ranged.join(F.broadcast(offs) if n_offs <= BROADCAST_ROWS else offs, cond)
            .select(*df.columns, *[((F.sum(c).over(wl) + F.col(f"_o{i}")) if how == "sum"
                                    else F.greatest(F.max(c).over(wl), F.col(f"_o{i}"))).alias(o)
                                   for i, (c, o) in enumerate(zip(sums, out))]))
