"""Session construction and cluster-safe scratch locations.

Library code never invents a machine-local folder: lineage is cut in the
shared folder named by ``spark.checkpoint.dir``. Only tests and local runs set
that folder themselves, and only when the session leaves it unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every session of ours uses. Session time zone is UTC so that the
# test parquet's timestamp_ntz values cast to timestamp without a shift.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "equiscope") -> SparkSession:
    """A local session for tests and benchmarks (never used on a cluster)."""
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g"))
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting a scratch one only if unset.

    On a cluster the operator of the cluster names a shared folder in
    ``spark.checkpoint.dir``; we read and use it. Only a local-mode session
    (tests, local runs) with nothing set gets a fresh scratch folder; on a
    cluster a machine-local folder would not be shared by the executors, so
    an unset folder is an error there.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder shared by all executors "
                           "(e.g. on the cluster's distributed file system)")
    scratch = tempfile.mkdtemp(prefix="equiscope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", scratch)
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _write(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """The table as column files in the shared checkpoint folder: what made it runs once, and every reader scans only its columns."""
    return _write(df)[0]


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """``written`` for the passes run inside; the files are freed afterwards."""
    table, path = _write(df)
    try:
        yield table
    finally:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
