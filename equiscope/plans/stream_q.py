"""Registered queries: streaming operators and their batch twins (ST1-ST3)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..session import ensure_checkpoint_dir
from ..sources.tables import cand, table, with_cand
from ..streaming import admission as AD
from ..streaming import monitor as MO
from ..streaming import peers as PE
from .registry import register

REF_END = "2024-01-15"
BINS = 10


def events(spark, sf):
    """Events with ``ts`` as a session-zone timestamp (NTZ → timestamp, T14)."""
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _scratch(spark, kind):
    return os.path.join(ensure_checkpoint_dir(spark), f"{kind}-{uuid.uuid4().hex}")


def _tz(spark):
    return spark.conf.get("spark.sql.session.timeZone")


def _events_stream(spark, sf):
    """Events as a stream. ``ts`` (timestamp_ntz) becomes the instant whose UTC
    wall clock is the stored value, whatever the session time zone, so event
    time windows fall on the same day boundaries as the NTZ batch form."""
    ev = table(spark, sf, "events")
    return (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
            .option("pathGlobFilter", "events.parquet").parquet(sf.rstrip("/"))
            .withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), _tz(spark))))


def _to_ntz(spark, c):
    """Inverse of the conversion in ``_events_stream``: instant → stored NTZ value."""
    return F.to_utc_timestamp(c, _tz(spark)).cast("timestamp_ntz")


def admission_sql(limit: int = 60, window_s: int = 60) -> str:
    """ST1 as a DuckDB recursive CTE: per key, events in (ts, event_id) order
    carry the list of allowed timestamps still inside the window."""
    w = window_s * 1_000_000
    kept = f"list_filter(a.dq, lambda x: e.t - x < {w})"
    return f"""
WITH RECURSIVE ev AS (
  SELECT CAST(user_id AS BIGINT) AS key, CAST(event_id AS BIGINT) AS event_id, ts, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
adm AS (
  SELECT key, rn, event_id, ts, [t] AS dq, true AS allowed FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.key, e.rn, e.event_id, e.ts,
         CASE WHEN len({kept}) < {limit} THEN list_append({kept}, e.t) ELSE {kept} END,
         len({kept}) < {limit}
  FROM adm a JOIN ev e ON e.key = a.key AND e.rn = a.rn + 1)
SELECT key, event_id, ts, allowed, CAST(len(dq) AS INTEGER) AS allowed_in_window FROM adm"""


@register("admission_audit", admission_sql(), ops=("ST1",))
def admission_audit(spark, sf):
    """ST1 batch over the whole events table (timestamps kept as timestamp_ntz)."""
    return AD.admission_batch(table(spark, sf, "events"))


@register("admission_audit_stream", admission_sql(), ops=("ST1",))
def admission_audit_stream(spark, sf):
    """The stream reads the events file as one micro-batch, so it must equal the
    batch rule; ``ts`` goes back to timestamp_ntz (the stream needed a timestamp
    for its watermark, T14)."""
    out, ck = _scratch(spark, "admission-out"), _scratch(spark, "admission-ck")
    q = (AD.admission_stream(_events_stream(spark, sf)).writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", ck).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).select("key", "event_id", _to_ntz(spark, F.col("ts")).alias("ts"),
                                          "allowed", "allowed_in_window")


def _monitor_parts(spark, sf):
    # batch form windows the NTZ timestamps directly: no session-time-zone dependence
    ev = table(spark, sf, "events")
    ref = ev.where(F.col("ts") < F.lit(REF_END).cast("timestamp_ntz"))
    lo, hi = MO.reference_edges(ref, "value")
    return ev, MO.reference_shares(ref, "value", lo, hi, BINS), lo, hi


WINDOW_PSI_SQL = f"""
WITH ev AS (SELECT ts, value FROM events WHERE value IS NOT NULL),
r AS (SELECT min(value) AS lo, max(value) AS hi FROM ev WHERE ts < TIMESTAMP '{REF_END}'),
rb AS (SELECT CAST(least(greatest(floor((value - lo) * ({BINS} / (hi - lo))), 0), {BINS - 1}) AS INTEGER) AS bin,
              count(*) AS c FROM ev, r WHERE ts < TIMESTAMP '{REF_END}' GROUP BY 1),
shares AS (SELECT g.bin, coalesce(rb.c, 0) / (SELECT count(*) FROM ev WHERE ts < TIMESTAMP '{REF_END}') AS e
           FROM (SELECT CAST(range AS INTEGER) AS bin FROM range({BINS})) g LEFT JOIN rb USING (bin)),
cc AS (SELECT date_trunc('day', ts) AS ws,
              CAST(least(greatest(floor((value - lo) * ({BINS} / (hi - lo))), 0), {BINS - 1}) AS INTEGER) AS bin,
              count(*) AS cnt FROM ev, r GROUP BY 1, 2),
tot AS (SELECT ws, sum(cnt) AS n FROM cc GROUP BY ws),
j AS (SELECT t.ws, t.n, s.bin, coalesce(cc.cnt, 0) / t.n AS a0, s.e AS e0
      FROM tot t CROSS JOIN shares s LEFT JOIN cc ON cc.ws = t.ws AND cc.bin = s.bin)
SELECT ws AS window_start, ws + INTERVAL 1 DAY AS window_end, CAST(n AS BIGINT) AS rows,
       round(sum((CASE WHEN a0 = 0 THEN 0.0001 ELSE a0 END - CASE WHEN e0 = 0 THEN 0.0001 ELSE e0 END)
                 * ln(CASE WHEN a0 = 0 THEN 0.0001 ELSE a0 END / CASE WHEN e0 = 0 THEN 0.0001 ELSE e0 END)), 4) AS psi
FROM j GROUP BY ws, n"""


@register("windowed_psi", WINDOW_PSI_SQL, ops=("ST3",))
def windowed_psi(spark, sf):
    ev, shares, lo, hi = _monitor_parts(spark, sf)
    counts = MO.window_counts(ev, "ts", "value", lo, hi, BINS)
    out = MO.window_psi(counts, shares, BINS)
    return round_doubles(out.select("window_start", "window_end", "rows", "psi"))


# The stream emits a window in append mode once the watermark (max event time
# - 1 hour) has passed its end; later windows stay in state.
WATERMARK = "1 hour"
WINDOW_PSI_FINAL_SQL = WINDOW_PSI_SQL.replace(
    "FROM j GROUP BY ws, n",
    "FROM j WHERE ws + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ws, n")


@register("windowed_psi_stream", WINDOW_PSI_FINAL_SQL, ops=("ST3",))
def windowed_psi_stream(spark, sf):
    _ev, shares, lo, hi = _monitor_parts(spark, sf)
    out, ck = _scratch(spark, "monitor-out"), _scratch(spark, "monitor-ck")
    counts = MO.monitor_stream(_events_stream(spark, sf), "ts", "value", lo, hi, BINS, watermark=WATERMARK)
    q = (counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    psi = MO.window_psi(spark.read.parquet(out), shares, BINS)
    return round_doubles(psi.select(_to_ntz(spark, F.col("window_start")).alias("window_start"),
                                    _to_ntz(spark, F.col("window_end")).alias("window_end"), "rows", "psi"))


@register("peer_stats_stream", with_cand("""
SELECT job_role, count(salary) AS count, round(avg(salary), 4) AS mean_salary,
       CAST(trunc(quantile_cont(salary, 0.25)) AS INTEGER) AS percentile_25,
       CAST(trunc(quantile_cont(salary, 0.5)) AS INTEGER) AS median_salary,
       CAST(trunc(quantile_cont(salary, 0.75)) AS INTEGER) AS percentile_75
FROM cand WHERE salary IS NOT NULL GROUP BY job_role"""), ops=("ST2", "S8"))
def peer_stats_stream(spark, sf):
    li = table(spark, sf, "lineitem")
    stream = (spark.readStream.schema(li.schema).option("pathGlobFilter", "lineitem.parquet")
              .parquet(sf.rstrip("/")))
    rows = cand(spark, sf, lineitem=stream).select("job_role", "salary", "years_experience")
    prof, stats, ck = _scratch(spark, "profiles"), _scratch(spark, "role-stats"), _scratch(spark, "peers-ck")
    q = PE.start_peer_stream(spark, rows, prof, stats, ck)
    q.awaitTermination()
    return round_doubles(spark.read.parquet(stats))
