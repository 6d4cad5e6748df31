"""Contiguous shards of nearly equal bytes, cut from global prefix sums of sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_prefix, materialise, spread_join

#: How far a shard may leave its byte target so that equal texts stay together: a group of at most this part of the
#: target is never cut. Larger groups are, since whole they would make shards unequal.
WHOLE_GROUP_SHARE = 0.02


def assign_shards(docs: DataFrame, n_shards: int, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, whole_group_share: float = WHOLE_GROUP_SHARE) -> DataFrame:
    """One row per input row: id, ``size``, ``text_crc32``, ``shard``, ``slot``, ``byte_start``.

    Rows stand in the global order (md5 of the text, id), so copies are
    neighbours.  Each row's start is the sum of all sizes before it, made from
    per-partition totals, and shard ``floor(start * n_shards / total)`` follows:
    cuts lie at equal byte targets and shards are runs of that order.  A group of
    equal texts with at most ``whole_group_share`` of a shard's target takes the
    shard of its first row; a larger one is cut like other rows.  So a shard
    leaves its target by that share and one row at most.  Sizes are UTF-8 bytes
    plus ``overhead``.

    NULL text counts as no bytes and is one group; NULL ids sort first; repeated
    rows each get their own slot; very long texts only widen their shard by
    their own size; an empty table gives no rows; other columns are ignored.
    """
    light = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("")).alias("group"),
    )
    placed = global_prefix(light, [F.col("group"), F.col("id").asc_nulls_first()], "size", "shard-rows")
    total = light.agg(F.sum("size")).first()[0] or 1
    # partial sums before the shuffle: a group of any size is one row per task
    groups = placed.groupBy("group").agg(F.min("__before").alias("first"), F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # a row alone is not moved
    small = groups.filter("rows > 1").filter(F.col("bytes") <= F.lit(whole_group_share * total / n_shards)).select("group", "first", "rows")
    cut = spread_join(placed, materialise(small, "shard-groups"), ["group"], n="rows", by="id", how="left")
    start = F.coalesce("first", "__before")
    shard = F.least(F.floor(start * F.lit(float(n_shards)) / F.lit(float(total))), F.lit(n_shards - 1)).cast("int")
    cut = cut.withColumn("shard", shard)
    firsts = cut.groupBy("shard").agg(F.min("__row").alias("__first"))  # at most n_shards rows
    return cut.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("__row") - F.col("__first")).alias("slot"), F.col("__before").alias("byte_start")
    )
