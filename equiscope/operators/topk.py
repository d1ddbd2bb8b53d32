"""Top-k per group and global ranks without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                    salt_cols: Sequence[str], salts: int = 16, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k within each group by ``order`` (which must be a total order).

    For k up to Spark's window-group-limit threshold
    (``spark.sql.optimizer.windowGroupLimitThreshold``, 1000 by default) one
    ``row_number() ≤ k`` suffices: Spark evaluates it as a per-partition group
    limit *before* the shuffle and again after it, so each map task sends at
    most k rows per group, however hot the group. Above the threshold the
    limit is not pushed down, so the rank runs in two phases: top-k per
    (group, salt) with salt = hash(salt_cols) mod ``salts``, then over the
    ≤ k·salts survivors of each group.
    """
    keys = list(keys)
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k <= threshold:
        w = W.partitionBy(*keys).orderBy(*order)
        return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(salts)))
    w1 = W.partitionBy(*keys, "_salt").orderBy(*order)
    s1 = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).drop("_r", "_salt")
    w2 = W.partitionBy(*keys).orderBy(*order)
    return s1.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)


def page_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], page: int,
                   size: int, salt_cols: Sequence[str], salts: int = 16) -> DataFrame:
    """Rows of page ``page`` (1-based, ``size`` per page) in every group."""
    top = top_k_per_group(df, keys, order, page * size, salt_cols, salts, rank_col="_rank")
    return top.where(F.col("_rank") > (page - 1) * size).withColumnRenamed("_rank", "position")


def global_rank(df: DataFrame, value: str, rows_per_task: int | None = None) -> DataFrame:
    """0-based rank of every row by ``value`` (ties ordered by the remaining
    columns) as a distributed prefix sum: range partitions of (value, others)
    sized from the row count, so a hot value is split across tasks by its
    tie-breakers (``prefix.running_totals``). Returns df + ``rank`` + ``n``."""
    from .prefix import ROWS_PER_TASK, running_totals

    n = df.count()
    others = [c for c in df.columns if c != value]
    run = running_totals(df.withColumn("_one", F.lit(1).cast("long")), [], [value, *others], ["_one"],
                         ["_r"], rows=n, rows_per_task=rows_per_task or ROWS_PER_TASK)
    return run.select(*df.columns, (F.col("_r") - 1).alias("rank"), F.lit(n).cast("long").alias("n"))
