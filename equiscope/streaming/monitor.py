"""ST3 — drift monitor: PSI of each event-time window against a reference.

Reference shares over ``bins`` equal-width bins on the reference range are a
tiny static table (``bins`` rows). Current values are binned with the same
edges (values outside the range go to the edge bins), counted per
(window, bin) — in a stream with a watermark so late rows beyond it are
dropped and window state is finalised — and PSI is computed per window by
joining the counts with the reference shares (empty share ⇒ 0.0001).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dlit
from ..roles import PSI_EMPTY_SHARE


def reference_edges(ref: DataFrame, value: str) -> tuple[float, float]:
    r = ref.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    lo, hi = float(r["lo"]), float(r["hi"])
    return (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)


def bin_col(value: str, lo: float, hi: float, bins: int):
    b = F.floor((F.col(value) - dlit(lo)) * dlit(bins / (hi - lo)))
    return F.least(F.greatest(b, F.lit(0)), F.lit(bins - 1)).cast("int")


def reference_shares(ref: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    spark = ref.sparkSession
    v = ref.where(F.col(value).isNotNull())
    counts = v.groupBy(bin_col(value, lo, hi, bins).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    n = v.count()  # one scalar
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.coalesce(F.col("c"), F.lit(0)) / F.lit(float(n))).alias("e")))


def window_counts(cur: DataFrame, ts: str, value: str, lo: float, hi: float, bins: int,
                  window: str = "1 day") -> DataFrame:
    return (cur.where(F.col(value).isNotNull())
            .groupBy(F.window(F.col(ts), window).alias("w"), bin_col(value, lo, hi, bins).alias("bin"))
            .agg(F.count(F.lit(1)).alias("cnt")))


def window_psi(counts: DataFrame, shares: DataFrame, bins: int) -> DataFrame:
    """PSI per window from (w, bin, cnt) counts and (bin, e) reference shares."""
    spark = counts.sparkSession
    tot = counts.groupBy("w").agg(F.sum("cnt").alias("n"))
    grid = tot.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    j = (grid.join(counts, ["w", "bin"], "left").join(F.broadcast(shares), "bin"))
    a = F.coalesce(F.col("cnt"), F.lit(0)) / F.col("n")
    a = F.when(a == 0, dlit(PSI_EMPTY_SHARE)).otherwise(a)
    e = F.when(F.col("e") == 0, dlit(PSI_EMPTY_SHARE)).otherwise(F.col("e"))
    return (j.groupBy("w", "n").agg(F.sum((a - e) * F.ln(a / e)).alias("psi"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    F.col("n").alias("rows"), "psi"))


def monitor_stream(stream: DataFrame, ts: str, value: str, lo: float, hi: float, bins: int,
                   window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Streaming (window, bin) counts, finalised when the watermark passes."""
    return window_counts(stream.withWatermark(ts, watermark), ts, value, lo, hi, bins, window)
