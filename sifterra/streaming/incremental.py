"""Incremental chunking: a stream of documents in, chunks of new or changed contents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import markdown

VERSIONS = "document_id string, content_hash string"


def _latest(spark: SparkSession, output: str, before: int | None = None) -> DataFrame:
    """(document_id, content_hash, epoch) of each document's last version, or of the last before an epoch."""
    seen = spark.read.schema(f"{VERSIONS}, epoch long").parquet(f"{output}/versions")
    seen = seen if before is None else seen.filter(F.col("epoch") < before)
    return seen.groupBy("document_id").agg(F.max_by("content_hash", "epoch").alias("content_hash"), F.max("epoch").alias("epoch"))


def chunk_stream(documents: DataFrame, output: str, checkpoint: str, config: markdown.ChunkerConfig = markdown.ChunkerConfig(), *, time_col: str | None = None) -> StreamingQuery:
    """Append chunks of documents whose content differs from their last one, a micro-batch at a time.

    A document that returns to an earlier content is written again, and one that became empty is noted without
    chunks.  Of several versions in one micro-batch the latest by ``time_col`` counts (by hash, if that is equal or
    not given).  Each epoch writes ``versions/epoch=N``, a row for each changed document, and ``chunks/epoch=N``; it reads
    earlier epochs only, so a repeated epoch replaces its own rows by equal ones.
    """
    output = output.rstrip("/")
    spark = documents.sparkSession
    spark.createDataFrame([], VERSIONS).write.mode("ignore").parquet(f"{output}/versions/epoch=-1")
    order = [F.desc(c) for c in ([time_col] if time_col else []) + ["content_hash"]]

    def write(batch: DataFrame, epoch: int) -> None:
        newest = batch.withColumn("nth", F.row_number().over(W.partitionBy("document_id").orderBy(*order))).filter("nth = 1").drop("nth")
        before = _latest(batch.sparkSession, output, epoch).drop("epoch")
        fresh = newest.join(before, ["document_id", "content_hash"], "left_anti")
        fresh.select("document_id", "content_hash").write.mode("overwrite").parquet(f"{output}/versions/epoch={epoch}")
        markdown.chunks(fresh, markdown.sections(fresh), config).write.mode("overwrite").parquet(f"{output}/chunks/epoch={epoch}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_chunks(spark: SparkSession, output: str) -> DataFrame:
    """Chunks of each document's last content, with the ``epoch`` that made them; none of an empty document."""
    output = output.rstrip("/")
    return spark.read.parquet(f"{output}/chunks").join(_latest(spark, output).select("document_id", "epoch"), ["document_id", "epoch"])
