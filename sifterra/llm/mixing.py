"""Mix sources to target weights by repeating documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_prefix, materialise, quoted, word_count

#: Up to so many sources the rate table is broadcast (a row holds a name and five numbers); beyond, the join is salted.
BROADCAST_SOURCES = 10_000
SALTS = 64


def chance(seed: str, key: Column) -> Column:
    """A number in [0, 1) that depends on ``seed`` and ``key`` only."""
    digest = F.substring(F.md5(F.concat(F.lit(seed), key).cast("binary")), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(2**32))


def source_rates(sizes: DataFrame, *, cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Per ``source``: ``source_size``, ``weight``, ``target`` and ``rate`` from rows (source, size).

    Weights run through ``cycle`` in the sources' code-point order, NULL last.
    Targets share the total of all sizes by weight but stop at ``most`` times
    the source's own size; what is cut off is shared again among the rest until
    no target is above.  That is the level L with sum(min(most * size, L *
    weight)) = total, and each round needs two sums over the source table.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_prefix(per, [F.col("source").asc_nulls_last()], "source_size", "sources")
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (F.col("__row") % len(cycle) + 1).cast("int"))
    ranked = materialise(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")), "source-weights")
    total, weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, level = float(total or 0), float(total or 0) / float(weights or 1)
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        capped, free = ranked.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if not free:
            break
        higher = (total - float(capped or 0)) / float(free)
        if higher <= level:
            break
        level = higher
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(1.0))
    return ranked.select("source", "source_size", "weight", target.alias("target"), rate.alias("rate"))


def mix(docs: DataFrame, *, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", seed: str = "mix-1", cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``row`` (a struct of the input's columns, whatever their names), ``size``, ``source_size``, ``target`` and ``copies``.

    A document is taken floor(rate) times plus once more when a number hashed
    from (seed, id) falls under the fraction, so reruns agree.  The size is the
    number of words.

    NULL text has size 0; NULL source is a source of its own, last in order; a
    NULL id hashes as the empty string; repeated rows get equal decisions; a
    source without words keeps each row once and takes no words; an empty
    table gives no rows.
    """
    rates = materialise(source_rates(docs.select(F.col(quoted(source_col)).alias("source"), word_count(F.col(quoted(text_col))).alias("size")), cycle=cycle, most=most), "source-rates")
    few = rates.count() <= BROADCAST_SOURCES
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"))
    same = F.col("row").getField(source_col).eqNullSafe(F.col("source"))
    if few:
        joined = rows.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = rows.withColumn("salt", F.pmod(F.xxhash64(F.col("row").getField(id_col)), F.lit(SALTS)).cast("int"))
        joined = left.join(salted, same & (F.col("salt") == F.col("salt2")))
    whole = F.floor("rate")
    extra = chance(seed, F.coalesce(F.col("row").getField(id_col).cast("string"), F.lit(""))) < F.col("rate") - whole
    return joined.select("row", word_count(F.col("row").getField(text_col)).alias("size"), "source_size", "target", (whole + extra.cast("int")).cast("int").alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mixed corpus itself: every row of ``mix``'s input as many times as it is taken; no rows for none."""
    return mixed.filter(F.col("copies") > 0).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
