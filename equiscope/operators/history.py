"""Prediction-history queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dlit, js_round
from .features import percent_label
from .topk import page_per_group


def filter_history(df: DataFrame, ts: str = "created_at", amount: str = "predicted_salary",
                   date_from=None, date_to=None, min_amount=None, max_amount=None) -> DataFrame:
    """Each filter optional and inclusive; applied before paging so it
    reaches the scan as a pushed predicate."""
    cond = F.lit(True)
    if date_from is not None:
        cond = cond & (F.col(ts) >= F.lit(date_from).cast(df.schema[ts].dataType))
    if date_to is not None:
        cond = cond & (F.col(ts) <= F.lit(date_to).cast(df.schema[ts].dataType))
    if min_amount is not None:
        cond = cond & (F.col(amount) >= dlit(min_amount))
    if max_amount is not None:
        cond = cond & (F.col(amount) <= dlit(max_amount))
    return df.where(cond)


def history_page(df: DataFrame, user: str = "user_id", ts: str = "created_at", pid: str = "id",
                 page: int = 1, size: int = 20) -> DataFrame:
    """O1 for every user at once: newest first, id as tie-break, page ``page``."""
    return page_per_group(df, [user], [F.col(ts).desc(), F.col(pid).desc()], page, size,
                          salt_cols=[pid])


def lookup_owned(df: DataFrame, lookups: DataFrame, pid: str = "id", user: str = "user_id") -> DataFrame:
    """P16 in batch: the records whose id *and* owner match a lookup (semi-join)."""
    return df.join(lookups.select(pid, user).distinct(), [pid, user], "left_semi")


def match_case_insensitive(df: DataFrame, col: str, keys: DataFrame, key_col: str) -> DataFrame:
    """Rows whose ``col`` equals a key ignoring case."""
    k = keys.select(F.lower(F.col(key_col)).alias("_k")).distinct()
    return df.join(k, F.lower(F.col(col)) == F.col("_k"), "left_semi")


def history_kpis(df: DataFrame, amount: str = "predicted_salary") -> DataFrame:
    """Total, JS-rounded average (0 when empty), max (0 when empty)."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.coalesce(js_round(F.avg(amount)), F.lit(0)).cast("bigint").alias("avg_amount"),
                  F.coalesce(F.max(amount), dlit(0.0)).alias("max_amount"))


def role_label(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("N/A"))


def history_by_role(df: DataFrame, role: str = "job_role", amount: str = "predicted_salary") -> DataFrame:
    """Per role (missing/empty → 'N/A') rounded average and max."""
    return df.groupBy(role_label(F.col(role)).alias("role")).agg(
        js_round(F.avg(amount)).cast("bigint").alias("avg"), F.max(amount).alias("max"),
        F.count(F.lit(1)).alias("count"))


def history_trend(df: DataFrame, ts: str = "created_at", amount: str = "predicted_salary",
                  pid: str = "id") -> DataFrame:
    """(day-month label, amount) in time order.

    A global sort range-partitions on its keys; the record id (when present)
    is a tie-breaker, so many records sharing one timestamp are still split
    across ranges instead of landing in one task."""
    ties = [F.col(pid)] if pid in df.columns else [F.col(amount)]
    return (df.select(F.date_format(F.col(ts), "dd MMM").alias("date"), F.col(amount).alias("salary"),
                      F.col(ts), *ties)
            .orderBy(F.col(ts), *ties)
            .select("date", "salary", ts))


def history_export(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """Export rows with ISO time and ``Math.round(conf*100)%``."""
    return df.select(
        F.date_format(F.to_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("date"),
        F.coalesce(F.col("job_role"), F.lit("")).alias("role"),
        F.coalesce(F.col("location"), F.lit("")).alias("location"),
        F.coalesce(F.col("experience_years"), dlit(0.0)).alias("experience"),
        F.col("predicted_salary").alias("predicted"), F.col("min_salary").alias("min"),
        F.col("max_salary").alias("max"), percent_label(F.col("confidence")).alias("confidence"))


def with_owner(predictions: DataFrame, users: DataFrame, user: str = "user_id") -> DataFrame:
    """Predictions left-joined to their users."""
    return predictions.join(users, user, "left")


def orphans(predictions: DataFrame, users: DataFrame, user: str = "user_id") -> DataFrame:
    """Predictions whose user does not exist (anti-join)."""
    return predictions.join(users.select(user), user, "left_anti")
