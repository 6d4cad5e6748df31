"""What the operators share: tables, shared storage, joins of hot keys, global order and prefix sums.

Intermediate tables go to the folder in ``spark.checkpoint.dir``, which every
executor and the driver see; only a driver whose executors are its own threads
may do without that setting.  Nothing here depends on how many rows a key holds.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the contracts: runs of anything but ASCII blanks.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: What bounds memory where rows hold whole texts: rows of an Arrow batch and of a batch of the Parquet reader.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def bound_batches(spark: SparkSession) -> None:
    """Set ``BATCHES`` in the session: Spark's defaults (10,000 and 4,096 rows) fill a worker's memory with long texts.

    The settings stay: plans are run after this returns.  They change no result.
    """
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; without one an error, but for local mode, which gets a temporary folder."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not conf:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = f"file://{tempfile.mkdtemp(prefix='sifterra-')}"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one: ``clear`` deletes what results no longer need."""
    return f"{shared_dir(spark)}/sifterra/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Delete every table that this application wrote to the shared folder. Results that still read one must be saved before."""
    _delete(spark, work_dir(spark))


def materialise(df: DataFrame, name: str, compression: str = "lz4") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sifterra_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so once the driver has collected its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_sifterra_path", None)
        if path:
            _delete(df.sparkSession, path)


#: Rows of ids (some 50 bytes each) up to which they are broadcast; beyond, both sides are shuffled. Results are the same.
BROADCAST_IDS = 200_000

#: Most bits of a filter of ids (16 MB broadcast). More ids make it less selective, not wrong.
FILTER_BITS = 1 << 27


class IdFilter:
    """A one-hash Bloom filter of ids, of at most ``FILTER_BITS`` bits."""

    def __init__(self, ids: DataFrame):
        n = ids.agg(F.approx_count_distinct("id")).first()[0]
        self.bits = min(FILTER_BITS, max(1 << 12, 1 << (16 * n).bit_length()))
        at = F.pmod(F.xxhash64("id"), F.lit(self.bits))
        words = ids.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(id), 64) as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
        rows = words.toArrow()  # bits / 64 rows at most
        held = np.zeros(self.bits // 64, np.int64)
        held[rows["word"].to_numpy()] = rows["bit"].to_numpy()
        self.held: Broadcast = ids.sparkSession.sparkContext.broadcast(held.view(np.uint64))

    def column(self):
        return F.pmod(F.xxhash64("id"), F.lit(self.bits))

    def wanted(self, at: np.ndarray) -> np.ndarray:
        return (self.held.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ... so that no name can clash with an operator's own, and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def quoted(name: str) -> str:
    """A column's name for ``F.col``, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def drop_rows(docs: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    """``docs`` without the rows whose ``key`` stands in ``bad`` (one column); rows with a NULL key stay.

    A bounded filter first tells which rows may be bad: only their texts are shuffled for the exact anti-join.
    No rows or no bad keys give ``docs`` back; columns may have any names.
    """
    plain, names = positional(docs)
    at = names[key]
    bad = materialise(bad.toDF("__bad").filter("__bad is not null").distinct(), "bad-keys")
    passing = IdFilter(bad.select(F.xxhash64("__bad").alias("id")))

    @F.pandas_udf("boolean")
    def maybe(x: pd.Series) -> pd.Series:
        return pd.Series(passing.wanted(x.to_numpy()))

    marked = plain.withColumn("__maybe", maybe(F.pmod(F.xxhash64(F.xxhash64(at)), F.lit(passing.bits))))
    clear = marked.filter(~F.col("__maybe"))
    checked = marked.filter("__maybe").join(bad, F.col(at) == F.col("__bad"), "left_anti")
    return clear.union(checked).drop("__maybe").toDF(*docs.columns)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], *, n: str, by: str, how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right``, which has one row for each key and in ``n`` how many rows of ``left`` have it.

    A key with more than a quarter of a partition's share of the rows is dealt to several tasks by a hash of
    the column ``by``.  There are at most four such keys for each partition; they and their numbers of tasks are
    broadcast, and without any this is a plain join.  ``how`` is "inner" or "left".
    """
    parts = 4 * partitions(left.sparkSession)
    total, most = right.agg(F.sum(n), F.max(n)).first()
    if not total or most * parts <= total:
        return left.join(right.drop(n), keys, how)
    hot = right.filter(F.col(n) * parts > total).select(*keys, F.ceil(F.col(n) * parts / F.lit(total)).cast("int").alias("__tasks"))
    hot = F.broadcast(materialise(hot, "hot-keys"))
    tasks = F.coalesce("__tasks", F.lit(1))
    left = left.join(hot, keys, "left").withColumn("__task", F.pmod(F.xxhash64(by), tasks).cast("int")).drop("__tasks")
    right = right.join(hot, keys, "left").withColumn("__task", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("__tasks", n)
    return left.join(right, [*keys, "__task"], how).drop("__task")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether a row is outside the training fold. A NULL id counts as training."""
    return F.coalesce(fold(doc_id, modulus) == F.lit(remainder), F.lit(False))


def word_count(text: Column) -> Column:
    """Words of a text as a long, 0 for NULL; stays in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def small_table(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A table of the driver's rows. It goes by Arrow: rows given as Python objects start Python workers of another kind."""
    return spark.createDataFrame(pa.table(columns))


def global_prefix(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Add ``__row`` (global row index) and ``__before`` (sum of ``value`` in all rows before).

    Rows are range-partitioned by ``order``, each partition is summed on its own,
    and only the totals (one row per partition) meet on the driver.  The ranged
    rows are materialised first, so a recomputed task cannot see other bounds.
    """
    spark = df.sparkSession
    n = partitions(spark)
    schema = T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__at", T.LongType()), T.StructField("__sum", T.LongType())])
    at = df.columns.index(value)

    def scan(batches):
        part, rows, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            values = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(values)
            extra = [np.full(len(values), part, np.int32), np.arange(rows, rows + len(values)), sums - values + total]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, extra)], names=schema.names)
            rows += len(values)
            total += int(sums[-1]) if len(values) else 0

    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    local = materialise(ranged.mapInArrow(scan, schema), name)
    totals = local.groupBy("__part").agg(F.count("*").alias("rows"), F.sum(value).alias("total")).collect()
    offsets, rows, total = [], 0, 0
    for t in sorted(totals, key=lambda t: t["__part"]):
        offsets.append((t["__part"], rows, total))
        rows, total = rows + t["rows"], total + t["total"]
    # one row per partition: bounded by the partition count
    start = small_table(spark, {"__part": pa.array([o[0] for o in offsets], pa.int32()), "__rows0": pa.array([o[1] for o in offsets], pa.int64()), "__sum0": pa.array([o[2] for o in offsets], pa.int64())})
    out = local.join(F.broadcast(start), "__part")
    return out.select(*df.columns, (F.col("__at") + F.col("__rows0")).alias("__row"), (F.col("__sum") + F.col("__sum0")).alias("__before"))


def next_row(df: DataFrame, key: str) -> DataFrame:
    """``df`` with the struct ``next``: the row that follows by descending integer ``key``, after the last one the first.

    NULL keys come last, equal keys go by a hash of the row. The rows are dealt into ranges whose bounds, one small row
    for each, meet on the driver; the first row of a range is also sent to the range before it, so no range looks
    beyond itself and whole rows are shuffled once, by the window.
    """
    spark, wanted = df.sparkSession, 4 * partitions(df.sparkSession)
    placed = df.withColumn("__k", F.coalesce(F.bitwise_not(F.col(key).cast("long")), F.lit((1 << 63) - 1))).withColumn("__t", F.xxhash64(*df.columns))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    light = placed.select("__k", "__t").repartitionByRange(wanted, "__k", "__t").sortWithinPartitions("__k", "__t")
    heads = light.mapInArrow(first, "__k long, __t long").toArrow()  # one row per range
    ks, ts = (heads[c].to_numpy() for c in ("__k", "__t"))
    order = np.lexsort((ts, ks))
    ks, ts, n = ks[order], ts[order], len(ks)

    @F.pandas_udf("long")
    def place(k: pd.Series, t: pd.Series) -> pd.Series:
        """Twice the row's range, plus one for a row at its very beginning."""
        k, t = k.to_numpy(), t.to_numpy()
        low, high = np.searchsorted(ks, k, "left"), np.searchsorted(ks, k, "right")
        at = low.copy()
        for a, b in set(zip(low[low < high].tolist(), high[low < high].tolist(), strict=True)):
            mine = (low == a) & (high == b)
            at[mine] = a + np.searchsorted(ts[a:b], t[mine], "right")
        at -= 1
        return pd.Series(2 * at + ((ks[at] == k) & (ts[at] == t)))

    dealt = placed.withColumn("__place", place("__k", "__t"))
    rows = dealt.withColumn("__part", F.shiftright("__place", 1)).withColumn("__after", F.lit(False))
    ahead = dealt.filter(F.col("__place") % 2 == 1).dropDuplicates(["__place"])
    ahead = ahead.withColumn("__part", F.pmod(F.shiftright("__place", 1) - 1, F.lit(max(1, n)))).withColumn("__after", F.lit(True))
    # each column by itself: a struct of them would be made before the shuffle and travel beside them
    beside = W.partitionBy("__part").orderBy("__after", "__k", "__t")
    led = rows.union(ahead).withColumns({f"__next{i}": F.lead(c).over(beside) for i, c in enumerate(df.columns)}).filter(~F.col("__after"))
    return led.select(*df.columns, F.struct(*[F.col(f"__next{i}").alias(c) for i, c in enumerate(df.columns)]).alias("next"))
