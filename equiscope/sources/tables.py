"""Driver table access and the candidate fixture view.

``cand`` maps the star-schema tables onto the salary candidate shape so that
every operator runs on real joins whose size grows with the scale factor. The
same view is written once in DuckDB SQL (``CAND_CTE``) for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import dlit

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


EDUCATION_BY_SIZE_MOD4 = ("High School", "Bachelor", "Master", "PhD")


def cand(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """One candidate row per line item (60,000 at sf0.01).

    Join order keeps the big side moving once per key: orders are enriched
    with customer → nation → region first (nation and region are fixed-size
    dimensions, broadcast unconditionally), then line items join that on the
    order key and part on the part key. Part and customer grow with the data,
    so they are left to AQE, which broadcasts them only when the measured
    shuffle output is under ``spark.sql.autoBroadcastJoinThreshold``.

    ``lineitem`` may be a streaming DataFrame: the view is then a
    stream-static join against the dimension tables.
    """
    li = (lineitem if lineitem is not None else table(spark, sf_dir, "lineitem")).select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")

    geo = F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
                      .select("n_nationkey", "r_name"))
    oc = (o.join(c, o.o_custkey == c.c_custkey)
          .join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
          .select("o_orderkey", "o_orderdate", "c_custkey", "c_mktsegment", "r_name"))
    j = (li.join(oc, li.l_orderkey == oc.o_orderkey)
         .join(p, F.col("l_partkey") == F.col("p_partkey")))

    edu = F.element_at(F.array(*[F.lit(e) for e in EDUCATION_BY_SIZE_MOD4]),
                       (F.col("p_size") % 4 + 1).cast("int"))
    return j.select(
        "l_orderkey", "l_linenumber", "o_orderdate",
        (F.col("p_size").cast("double") * dlit(0.6)).alias("years_experience"),
        F.col("l_linenumber").alias("skills_count"),
        F.when(F.col("l_orderkey") % 50 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("l_extendedprice")).alias("previous_salary"),
        (dlit(1.0) + F.col("l_discount") * dlit(90.0)).alias("interview_score"),
        edu.alias("education_level"),
        F.col("p_type").alias("job_role"),
        F.col("r_name").alias("location"),
        F.col("c_mktsegment").alias("company_size"),
        F.col("l_returnflag").alias("gender"),
        (F.lit(22) + F.col("c_custkey") % 44).cast("int").alias("age"),
        (F.col("l_extendedprice") * (dlit(1.0) - F.col("l_discount"))
         * (dlit(1.0) + F.col("l_tax"))).alias("salary"),
        (F.col("l_extendedprice") * dlit(0.95) + F.col("l_quantity") * dlit(12.5)
         + dlit(100.0)).alias("predicted_salary"),
    )


# DuckDB twin of ``cand`` (used by every oracle through ``with_cand``).
CAND_CTE = """cand AS (
  SELECT l.l_orderkey, l.l_linenumber, o.o_orderdate,
         CAST(p.p_size AS DOUBLE) * 0.6 AS years_experience,
         l.l_linenumber AS skills_count,
         CASE WHEN l.l_orderkey % 50 = 0 THEN NULL ELSE l.l_extendedprice END AS previous_salary,
         1.0 + l.l_discount * 90.0 AS interview_score,
         CASE p.p_size % 4 WHEN 0 THEN 'High School' WHEN 1 THEN 'Bachelor'
              WHEN 2 THEN 'Master' ELSE 'PhD' END AS education_level,
         p.p_type AS job_role,
         r.r_name AS location,
         c.c_mktsegment AS company_size,
         l.l_returnflag AS gender,
         CAST(22 + c.c_custkey % 44 AS INTEGER) AS age,
         l.l_extendedprice * (1.0 - l.l_discount) * (1.0 + l.l_tax) AS salary,
         l.l_extendedprice * 0.95 + l.l_quantity * 12.5 + 100.0 AS predicted_salary
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""


def with_cand(body: str, *more_ctes: str) -> str:
    """Prefix an oracle query with the cand CTE (and optional further CTEs)."""
    ctes = ",\n".join((CAND_CTE,) + more_ctes)
    return f"WITH {ctes}\n{body}"
