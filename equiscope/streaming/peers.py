"""ST2 — incremental peer statistics.

New candidate records arrive as files. Each micro-batch (``foreachBatch``):

1. adds the batch to the profile table (S8) as the partition of its epoch id,
   written with dynamic partition overwrite — a batch that Spark replays
   after a failure rewrites its own partition instead of appending twice;
2. recomputes exact role statistics only for the roles the batch touched,
   reading the profile table with a pushed-down ``job_role IN (...)`` filter;
3. overwrites just those roles' partitions of the statistics table
   (dynamic partition overwrite), so a replayed batch yields the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def role_stats(profiles: DataFrame, role: str = "job_role", salary: str = "salary") -> DataFrame:
    from ..operators.quantile import grouped_quantiles
    q = grouped_quantiles(profiles, [role], salary, [0.25, 0.5, 0.75], count_col="count")
    m = profiles.groupBy(role).agg(F.avg(salary).alias("mean_salary"))
    return q.join(m, role).select(
        role, "count", "mean_salary", F.element_at("q", 1).cast("int").alias("percentile_25"),
        F.element_at("q", 2).cast("int").alias("median_salary"),
        F.element_at("q", 3).cast("int").alias("percentile_75"))


def start_peer_stream(spark: SparkSession, source: DataFrame, profile_path: str, stats_path: str,
                      checkpoint: str, role: str = "job_role", salary: str = "salary",
                      available_now: bool = True):
    """Start the stream (``source`` is a streaming DataFrame of profile rows)."""
    def batch(df: DataFrame, epoch: int):
        if df.isEmpty():
            return
        (df.withColumn("_batch", F.lit(epoch).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(profile_path))
        touched = [r[0] for r in df.select(role).distinct().collect()]  # distinct roles of one batch
        allp = spark.read.parquet(profile_path).where(F.col(role).isin(touched))
        (role_stats(allp, role, salary).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(role).parquet(stats_path))

    w = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
