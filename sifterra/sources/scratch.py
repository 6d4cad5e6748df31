"""A place for tables that queries write and read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """This application's own part of ``spark.checkpoint.dir``, which a cluster must name; local mode gets a temporary folder once."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='sifterra-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/sifterra-tables/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there, and lost executors don't change its rows."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch: Spark's default (10,000) fills the Python workers with long texts.
BATCH_ROWS = 1_000


def bound_batches(spark: SparkSession) -> None:
    """Set ``BATCH_ROWS`` in the session, unless it asks for less. The setting stays: plans are run after this returns. It changes no result."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def clear(spark: SparkSession) -> None:
    """Delete every table that this application wrote here. Results that still read one must be saved before."""
    target = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
