"""Column expressions (JVM-side, codegen-friendly) shared by all operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dlit(x: float) -> Column:
    """A DOUBLE literal (never DECIMAL, T19)."""
    return F.lit(float(x))


def safe_div(num: Column, den: Column) -> Column:
    """NULL when the divisor is 0 or NULL (ANSI mode raises on 1/0, T4)."""
    return F.try_divide(num, F.nullif(den, F.lit(0)))


def cut(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed interval labels: ``(e[i], e[i+1]] -> labels[i]``; outside -> NULL."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per interval")
    x = col(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > dlit(lo)) & (x <= dlit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr  # no otherwise: NULL outside the range


def map_values(c: str | Column, mapping: Mapping, passthrough: bool = False) -> Column:
    """Dictionary lookup; unmapped keys become NULL, or pass through unchanged."""
    x = col(c)
    expr = None
    for k, v in mapping.items():
        cond = x == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    if passthrough:
        return expr.otherwise(x) if expr is not None else x
    return expr


def in_flag(c: str | Column, values: Sequence) -> Column:
    """1 if the value is in the set, else 0 (NULL counts as not in the set)."""
    return F.coalesce(col(c).isin(list(values)).cast("int"), F.lit(0))


def log1p_guarded(c: str | Column) -> Column:
    """log(1+x) for x > -1, NULL otherwise."""
    x = col(c)
    return F.when(x > dlit(-1.0), F.log1p(x))


def js_round(c: str | Column) -> Column:
    """JavaScript ``Math.round``: floor(x + 0.5)."""
    return F.floor(col(c) + dlit(0.5))


def rnd(c: str | Column, digits: int = 4) -> Column:
    """Round half up as floor(x·10^d + 0.5)/10^d: plain IEEE arithmetic, so any
    engine given the same double returns the same double (``round`` differs
    between engines on ties of the decimal expansion)."""
    s = float(10 ** digits)
    return F.floor(col(c) * dlit(s) + dlit(0.5)) / dlit(s)


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every floating column (the query layer's last step, T20)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(rnd(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str],
            name_col: str = "feature", value_col: str = "value") -> DataFrame:
    """Wide-to-long with every value cast to double (one row per id and column)."""
    casted = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    return casted.unpivot(list(ids), list(values), name_col, value_col)
