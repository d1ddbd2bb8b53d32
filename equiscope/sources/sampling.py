"""Deterministic samples and splits keyed on row content.

Both are key-stable: a row's membership depends only on its key columns and
the seed, never on partitioning or task order, so a recomputed partition
(after an executor loss) yields the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(key: Sequence[str], seed: int) -> Column:
    return F.xxhash64(*[F.col(k) for k in key], F.lit(seed))


def hash_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """The n rows with the smallest (hash, key): a top-k (``TakeOrderedAndProject``),
    so each task keeps only n candidates; no full sort."""
    h = row_hash(key, seed)
    return df.withColumn("_h", h).orderBy("_h", *key).limit(n).drop("_h")


# Fixed values of the portable integer-key hash: modulus 2^31 - 1 (prime),
# Horner multiplier 1000003, final Park-Miller multiplier 48271.
_P, _MUL, _MIX = 2147483647, 1000003, 48271


def int_key_hash(key: Sequence[str], seed: int) -> Column:
    """A hash of integer key columns in plain 64-bit arithmetic (no overflow:
    every intermediate stays below 2^63), so any SQL engine computes the same
    value — used where a sample must be reproducible outside Spark."""
    h = F.lit(seed % _P).cast("long")
    for k in key:
        h = F.pmod(h * F.lit(_MUL) + F.pmod(F.col(k).cast("long"), F.lit(_P)), F.lit(_P))
    return F.pmod(h * F.lit(_MIX), F.lit(_P))


def int_key_hash_sql(key: Sequence[str], seed: int) -> str:
    """``int_key_hash`` as SQL text (pmod written as ((a % m) + m) % m)."""
    def pmod(a: str) -> str:
        return f"((({a}) % {_P} + {_P}) % {_P})"
    h = str(seed % _P)
    for k in key:
        h = pmod(f"{h} * {_MUL} + {pmod(f'CAST({k} AS BIGINT)')}")
    return pmod(f"{h} * {_MIX}")


def order_sample(df: DataFrame, score: Column, tie: Sequence[str], n: int) -> DataFrame:
    """The n rows with the smallest (score, tie...) — a top-k, no full sort.
    ``tie`` should make the order total over the columns the caller uses."""
    return df.withColumn("_h", score).orderBy("_h", *tie).limit(n).drop("_h")


def hash_fraction(df: DataFrame, key: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """About ``fraction`` of the rows, chosen by hash (a filter: no shuffle)."""
    return df.where(F.pmod(row_hash(key, seed), F.lit(10000)) < F.lit(int(round(fraction * 10000))))


def hash_split(df: DataFrame, key: Sequence[str], weights: Sequence[float], seed: int = 42,
               names: Sequence[str] | None = None, col: str = "split") -> DataFrame:
    """Label every row with one split name by hash bucket (80/20, 60/20/20, …)."""
    total = float(sum(weights))
    names = list(names or [f"part{i}" for i in range(len(weights))])
    b = F.pmod(row_hash(key, seed), F.lit(10000))
    expr, acc = None, 0.0
    for w, name in zip(weights[:-1], names[:-1]):
        acc += w / total
        cond = b < F.lit(int(round(acc * 10000)))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    expr = F.lit(names[-1]) if expr is None else expr.otherwise(F.lit(names[-1]))
    return df.withColumn(col, expr)
