"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, spread_join


def find(parent: dict[int, int], x: int) -> int:
    """Root of ``x``, with path halving; an unknown node is its own root."""
    while (up := parent.get(x, x)) != x:
        parent[x] = x = parent.get(up, up)
    return x


def _thinned(batches):
    """Links of a partition as one star for each component seen there."""
    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(parent, a), find(parent, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    roots = [find(parent, x) for x in nodes]
    u, v = np.array(nodes, np.int64), np.array(roots, np.int64)
    moved = u != v
    yield pa.RecordBatch.from_arrays([pa.array(u[moved]), pa.array(v[moved])], names=["u", "v"])


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``component``) for every node but the smallest of each component.

    ``links`` holds two columns of long ids in any order, repeats allowed.  The
    component is its smallest id.  Each round is two joins and two aggregates.
    Partial minima keep a hub of any degree to one row per task in the latter,
    and the joins deal a hub's links to several tasks.  What a round makes is
    written, so a lost executor costs a part of one round at most.
    """
    a, b = (F.col(c) for c in links.columns[:2])
    edges = links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    current = materialise(edges.mapInArrow(_thinned, "u long, v long").distinct(), "links")
    before = _mark(current)
    while before[0]:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both, least, ["u"], n="n", by="v").filter(F.col("v") > F.col("u"))
        large = materialise(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, lowest, ["u"], n="n", by="v").filter(F.col("v") > F.col("m"))
        after = materialise(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(current, large)
        current, now = after, _mark(after)
        if now == before:
            break
        before = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
