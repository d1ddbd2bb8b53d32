"""Registry of named queries: a Spark builder plus (optionally) its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: tuple[str, ...]  # SURVEY inventory ids covered


QUERIES: dict[str, Query] = {}


def _split_top(args: str) -> list[str]:
    parts, depth, cur, quote = [], 0, [], False
    for ch in args:
        if ch == "'":
            quote = not quote
        if not quote:
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 0:
                parts.append("".join(cur))
                cur = []
                continue
        cur.append(ch)
    parts.append("".join(cur))
    return parts


def exact_round_sql(sql: str) -> str:
    """Rewrite ``round(x, d)`` as ``floor(x·10^d + 0.5) / 10^d`` (see ``rnd``)."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        args = _split_top(sql[j + 6:k - 1])
        out.append(sql[i:j])
        if len(args) == 2 and args[1].strip().lstrip("-").isdigit():
            d = int(args[1])
            inner = exact_round_sql(args[0])
            out.append(f"(floor(({inner}) * CAST({10 ** d} AS DOUBLE) + 0.5) / CAST({10 ** d} AS DOUBLE))")
        else:
            out.append("round(" + exact_round_sql(sql[j + 6:k - 1]) + ")")
        i = k


def register(name: str, sql: str | None = None, ops: tuple[str, ...] = ()):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, exact_round_sql(sql) if sql else None, ops)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the plan modules fills QUERIES.
    # light queries first; the heaviest (k-NN pairs, ML training, streams) last
    from . import (metrics_q, fairness_q, features_q, conformal_q, drift_q,  # noqa: F401
                   profile_q, history_q, similar_q, stream_q, model_q, artefacts_q)
    return QUERIES
