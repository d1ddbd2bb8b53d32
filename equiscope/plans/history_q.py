"""Registered queries: prediction history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import dlit, round_doubles
from ..operators import history as H
from ..sources.documents import format_document, parse_documents
from ..sources.tables import table
from .registry import register


def predictions(spark, sf, request_fields: bool = True):
    """Orders as prediction records: id, owner, amount, time, request fields.

    Without ``request_fields`` the view is the orders scan alone: Catalyst
    cannot drop a left join it does not know to be key-unique, so queries that
    need no request field (KPIs, paging, lookups) skip the dimension joins.
    """
    o = table(spark, sf, "orders")
    if not request_fields:
        return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
                        F.col("o_totalprice").alias("predicted_salary"),
                        F.col("o_orderdate").alias("created_at"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    geo = F.broadcast(table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")),
                                                       F.col("n_regionkey") == F.col("r_regionkey"))
                      .select("n_nationkey", "r_name"))
    j = (o.join(c, o.o_custkey == c.c_custkey, "left")
         .join(geo, F.col("c_nationkey") == F.col("n_nationkey"), "left"))
    return j.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
                    F.col("o_totalprice").alias("predicted_salary"),
                    F.greatest(dlit(0.0), F.col("o_totalprice") - 20000.0).alias("min_salary"),
                    (F.col("o_totalprice") + 20000.0).alias("max_salary"),
                    ((F.col("o_custkey") % 100).cast("double") / 100.0 + 0.005).alias("confidence"),
                    F.col("o_orderdate").alias("created_at"),
                    F.col("c_mktsegment").alias("job_role"), F.col("r_name").alias("location"),
                    (F.col("o_custkey") % 30).cast("double").alias("experience_years"))


PRED_CTE = """pred AS (
  SELECT o.o_orderkey AS id, o.o_custkey AS user_id, o.o_totalprice AS predicted_salary,
         greatest(0.0, o.o_totalprice - 20000.0) AS min_salary, o.o_totalprice + 20000.0 AS max_salary,
         CAST(o.o_custkey % 100 AS DOUBLE) / 100.0 + 0.005 AS confidence,
         o.o_orderdate AS created_at, c.c_mktsegment AS job_role, r.r_name AS location,
         CAST(o.o_custkey % 30 AS DOUBLE) AS experience_years
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def w(body):
    return f"WITH {PRED_CTE}\n{body}"


@register("history_page_2", w("""
SELECT id, user_id, round(predicted_salary, 4) AS predicted_salary, created_at, position
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS position
      FROM pred) t
WHERE position > 20 AND position <= 40"""), ops=("O1",))
def history_page_2(spark, sf):
    p = H.history_page(predictions(spark, sf, request_fields=False), page=2, size=20)
    return round_doubles(p.select("id", "user_id", "predicted_salary", "created_at",
                                  F.col("position").cast("bigint").alias("position")))


FILTER_ARGS = dict(date_from="1996-01-01", date_to="1999-12-31", min_amount=100000.0,
                   max_amount=400000.0)
FILTER_SQL = """created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '1999-12-31'
  AND predicted_salary >= 100000.0 AND predicted_salary <= 400000.0"""


@register("history_kpis_filtered", w(f"""
SELECT count(*) AS total, CAST(coalesce(floor(avg(predicted_salary) + 0.5), 0) AS BIGINT) AS avg_amount,
       round(coalesce(max(predicted_salary), 0.0), 4) AS max_amount
FROM pred WHERE {FILTER_SQL}"""), ops=("P15", "E13"))
def history_kpis_filtered(spark, sf):
    f = H.filter_history(predictions(spark, sf, request_fields=False), **FILTER_ARGS)
    return round_doubles(H.history_kpis(f))


@register("history_by_role", w(f"""
SELECT coalesce(nullif(job_role, ''), 'N/A') AS role,
       CAST(floor(avg(predicted_salary) + 0.5) AS BIGINT) AS avg,
       round(max(predicted_salary), 4) AS max, count(*) AS count
FROM pred WHERE {FILTER_SQL} GROUP BY 1"""), ops=("P15", "E14"))
def history_by_role(spark, sf):
    f = H.filter_history(predictions(spark, sf), **FILTER_ARGS)
    return round_doubles(H.history_by_role(f))


@register("history_trend", w(f"""
SELECT strftime(created_at, '%d %b') AS date, round(predicted_salary, 4) AS salary, created_at
FROM pred WHERE {FILTER_SQL} ORDER BY created_at"""), ops=("E15",))
def history_trend(spark, sf):
    f = H.filter_history(predictions(spark, sf, request_fields=False), **FILTER_ARGS)
    return round_doubles(H.history_trend(f))


@register("history_export", w(f"""
SELECT strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS date, coalesce(job_role, '') AS role,
       coalesce(location, '') AS location, round(coalesce(experience_years, 0.0), 4) AS experience,
       round(predicted_salary, 4) AS predicted, round(min_salary, 4) AS min, round(max_salary, 4) AS max,
       CAST(CAST(floor(confidence * 100.0 + 0.5) AS BIGINT) AS VARCHAR) || '%' AS confidence
FROM pred WHERE {FILTER_SQL}"""), ops=("S12", "P20"))
def history_export(spark, sf):
    f = H.filter_history(predictions(spark, sf), **FILTER_ARGS)
    return round_doubles(H.history_export(f))


@register("lookup_owned", w("""
SELECT p.id, p.user_id, round(p.predicted_salary, 4) AS predicted_salary
FROM pred p SEMI JOIN (SELECT o_orderkey AS id,
                              CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_custkey + 1 END AS user_id
                       FROM orders) l ON p.id = l.id AND p.user_id = l.user_id"""), ops=("P16",))
def lookup_owned(spark, sf):
    o = table(spark, sf, "orders")
    lookups = o.select(F.col("o_orderkey").alias("id"),
                       F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey"))
                        .otherwise(F.col("o_custkey") + 1).alias("user_id"))
    got = H.lookup_owned(predictions(spark, sf, request_fields=False), lookups)
    return round_doubles(got.select("id", "user_id", "predicted_salary"))


@register("case_insensitive_match", """
SELECT c_custkey, c_name FROM customer
WHERE lower(c_name) IN (SELECT DISTINCT lower(upper(c_name)) FROM customer WHERE c_mktsegment = 'BUILDING')""",
          ops=("P17",))
def case_insensitive_match(spark, sf):
    c = table(spark, sf, "customer")
    keys = c.where(F.col("c_mktsegment") == "BUILDING").select(F.upper("c_name").alias("k"))
    return H.match_case_insensitive(c, "c_name", keys, "k").select("c_custkey", "c_name")


@register("predictions_with_users", """
SELECT count(*) AS predictions, count(c.c_custkey) AS with_user,
       (SELECT count(*) FROM orders o2 ANTI JOIN customer c2 ON o2.o_custkey = c2.c_custkey) AS orphans
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""", ops=("J6", "E16"))
def predictions_with_users(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"))
    u = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"),
                                            F.col("c_custkey").alias("uid"))
    # one pass: a left join row without a user is exactly an anti-join row
    return H.with_owner(o, u).agg(F.count(F.lit(1)).alias("predictions"),
                                  F.count("uid").alias("with_user"),
                                  F.count_if(F.col("uid").isNull()).alias("orphans"))


# Events' properties as documents; those of errors are cut short, so that malformed ones occur.
PROPS = "CASE WHEN event_type = 'error' THEN substring(props, 1, length(props) - 1) ELSE props END"


@register("event_documents", f"""
SELECT event_type, count(*) AS events, CAST(sum(CASE WHEN NOT json_valid(p) THEN 1 ELSE 0 END) AS BIGINT) AS malformed,
       CAST(sum(CASE WHEN json_valid(p) THEN CAST(json_extract_string(CASE WHEN json_valid(p) THEN p END, '$.k') AS BIGINT) END) AS BIGINT) AS sum_k,
       CAST(count(CASE WHEN json_valid(p) THEN 1 END) AS BIGINT) AS round_trips
FROM (SELECT event_type, {PROPS} AS p FROM events) t GROUP BY event_type""", ops=("S4",))
def event_documents(spark, sf):
    """Every event's properties parsed, counted by outcome, and held against their way to text and back."""
    e = table(spark, sf, "events").select("event_type", F.expr(PROPS).alias("p"))
    there = parse_documents(e, "p", "k bigint").withColumn("text", format_document("document"))
    back = parse_documents(there, "text", "k bigint", "again", "unreadable")
    return back.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("malformed").alias("malformed"), F.sum("document.k").alias("sum_k"),
        F.count(F.when(F.col("again") == F.col("document"), 1)).alias("round_trips"))
