"""Sources and sinks (S1-S8): files, reports, relational tables, refresh/append."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Raw candidate CSV schema (explicit: no inference pass over the data).
CANDIDATE_SCHEMA = T.StructType([
    T.StructField("years_experience", T.DoubleType()),
    T.StructField("education_level", T.StringType()),
    T.StructField("skills_count", T.DoubleType()),
    T.StructField("job_role", T.StringType()),
    T.StructField("previous_salary", T.DoubleType()),
    T.StructField("interview_score", T.DoubleType()),
    T.StructField("location", T.StringType()),
    T.StructField("company_size", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("salary", T.LongType()),
])


def nan_to_null(df: DataFrame) -> DataFrame:
    """SQL NULL is the only missing marker (pandas NaN becomes NULL)."""
    return df.select(*[F.when(F.isnan(F.col(f.name)), F.lit(None)).otherwise(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def read_candidates(spark: SparkSession, path: str, schema: T.StructType = CANDIDATE_SCHEMA) -> DataFrame:
    """Header CSV; columns are found by their header name, in any order.

    Fields are read as text and cast: integers by way of decimals, since a
    writer that knows NaN gives ``30.0`` for 30. Empty fields, NaN, integers
    with a fraction and what can't be cast are NULL. A column that the file
    lacks is an error; so is, of several files, one whose header is not the
    first one's, as its fields would fall under other names.
    """
    first = spark.read.option("header", True).csv(path)
    text = spark.read.schema(first.schema).option("header", True).option("enforceSchema", False).csv(path)
    missing = [f.name for f in schema.fields if f.name not in text.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")

    def cast(f: T.StructField):
        if isinstance(f.dataType, T.IntegralType):
            exact = F.col(f.name).try_cast("decimal(38,12)")
            return F.when(exact == F.floor(exact), exact.try_cast(f.dataType))
        return F.col(f.name).try_cast(f.dataType)

    return nan_to_null(text.select(*[cast(f).alias(f.name) for f in schema.fields]))


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """S2."""
    return spark.read.parquet(path)


def write_processed(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """S3: overwrite a Parquet dataset (optionally partitioned)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(str(path))


def write_report(df: DataFrame, path: str) -> None:
    """A tidy report table as JSON lines."""
    df.write.mode("overwrite").json(str(path))


def read_report(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame | None:
    """Read a report back with its schema; a missing report is ``None``."""
    try:
        return spark.read.schema(schema).json(str(path))
    except AnalysisException as e:
        if not _is_missing(e):
            raise
        return None


def _is_missing(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV (leaderboards, interval tables)."""
    df.write.mode("overwrite").option("header", True).csv(str(path))


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: int,
              upper: int, num_partitions: int, properties: dict | None = None) -> DataFrame:
    """A relational table read in ``num_partitions`` parallel range slices."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=num_partitions, properties=properties or {})


def refresh_table(df: DataFrame, path: str) -> None:
    """Full refresh (delete-all then insert, idempotent) = overwrite."""
    df.write.mode("overwrite").parquet(str(path))


def load_if_empty(spark: SparkSession, df: DataFrame, path: str) -> bool:
    """Load only when the target is missing or empty; True when loaded."""
    try:
        empty = spark.read.parquet(str(path)).isEmpty()
    except AnalysisException as e:  # anything else, such as a table that can't be read, is no empty table
        if not _is_missing(e):
            raise
        empty = True
    if empty:
        refresh_table(df, path)
    return empty


def append_rows(df: DataFrame, path: str, source: str | None = None) -> None:
    """Append records (optionally stamped with ``source``, e.g. 'real')."""
    if source is not None:
        df = df.withColumn("source", F.lit(source))
    df.write.mode("append").parquet(str(path))
