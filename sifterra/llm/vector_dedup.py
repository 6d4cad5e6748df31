"""Near-duplicate vectors: exact threshold pairs by dual traversal of cover trees.

Equal vectors are one point with a weight.  A bounded sample gives pivots; a
point belongs to the cell of its nearest pivot at the smallest halving radius
that covers it; cells too large for a block are cut again by pivots of their own.
Pairs of cells whose covering radii keep them apart are never brought together,
large ones wholly within reach of each other are not compared.  Cells are packed or cut into blocks of bounded size, a
cover tree is built once for each block.  The upper nodes of all trees are compared
on a grid first; every pair of blocks with nodes in reach of each other is one task
that walks both trees: node pairs beyond reach are pruned, node pairs wholly within
reach are counted without looking at their points.  No pair of
vectors leaves a task, only link counts and a spanning forest.
"""

from __future__ import annotations

import heapq
import pickle
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, materialise, small_table, spread_join
from .components import components, find

#: Sampled points that may become pivots, and points of a block.
PIVOTS, BLOCK = 256, 3_072
#: Halvings of the radius for cells.
LEVELS = 6
#: How often large cells are cut, and about how many sampled points all cells that are cut get together.
ROUNDS, SAMPLED = 5, 16_384
#: Blocks whose upper nodes are compared together, and rows of nodes at a time.
CHUNK, NODES = 64, 1_024
#: Most upper nodes of a tree: where points are all far from each other the root alone stands for them.
UPPER = 128
#: Points that a tree node keeps undivided.
LEAF = 48
#: Pairs of cells (17 bytes each, a few times over) that the driver holds at most.
MOST_PAIRS = 1 << 22
#: Most neighbouring blocks of a side that travel to a task together.
TOGETHER = 16
#: Cosines so near the threshold are taken again with exact sums.
NARROW = 1e-10
SLACK = 1e-7


def unit(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)  # neither overflow nor underflow
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


class CoverTree:
    """Nested nodes with halving radii over unit vectors; a node's points are one range of ``order``."""

    def __init__(self, points: np.ndarray):
        self.order = np.empty(len(points), np.int64)
        self.centre: list[int] = []
        self.span: list[tuple[int, int]] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray] = []
        self._build(points)

    def _build(self, points: np.ndarray) -> None:
        reach = angles(points @ points[0])
        stack = [(np.arange(len(points)), reach, max(1e-9, float(reach.max())), 0, -1)]
        below: dict[int, list[int]] = {}
        while stack:
            members, reach, radius, start, parent = stack.pop()
            node = len(self.centre)
            self.centre.append(int(members[0]))
            self.span.append((start, start + len(members)))
            self.radius.append(float(reach.max()))
            below.setdefault(parent, []).append(node)
            self.order[start : start + len(members)] = members
            if len(members) <= LEAF or self.radius[-1] < 1e-7:
                continue
            # a net at half the radius: every member joins the first centre that covers it
            half, left, at = min(radius, self.radius[-1]) / 2, members, start
            near = reach
            while len(left):
                if left[0] != members[0] or at != start:
                    near = angles(points[left] @ points[left[0]])
                    near[0] = 0.0
                covered = near <= half
                covered[0] = True
                stack.append((left[covered], near[covered], half, at, node))
                at += int(covered.sum())
                left = left[~covered]
        self.children = [np.array(below.get(n, []), np.int64) for n in range(len(self.centre))]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def frontier(self, most: float) -> np.ndarray:
        """Upper nodes that together hold all points: the widest are opened first, down to a radius of ``most`` and up to ``UPPER`` nodes."""
        out, heap = [], [(-float(self.radius[0]), 0)]
        while heap:
            radius, node = heapq.heappop(heap)
            below = self.children[node]
            if -radius <= most or not len(below) or len(out) + len(heap) + len(below) > UPPER:
                out.append(node)
            else:
                for child in below.tolist():
                    heapq.heappush(heap, (-float(self.radius[child]), child))
        return np.array(out, np.int64)


class Dual:
    """Link counts and a spanning forest between two blocks, or within one."""

    def __init__(self, a: dict, b: dict, threshold: float, same: bool):
        self.a, self.b, self.same, self.t, self.theta = a, b, same, threshold, float(np.arccos(threshold))
        self.counts = [np.zeros(len(x["ids"]), np.int64) for x in (a, b)]
        self.parent: dict[int, int] = {}

    def join(self, x: np.ndarray, root: np.ndarray) -> None:
        for i, j in zip(x.tolist(), root.tolist(), strict=True):
            i, j = find(self.parent, i), find(self.parent, j)
            if i != j:
                self.parent[max(i, j)] = min(i, j)

    def linked(self, rows: np.ndarray, cols: np.ndarray) -> None:
        """Compare points with points."""
        cosines = self.a["unit"][rows] @ self.b["unit"][cols].T
        link = cosines >= self.t
        for i, j in np.argwhere(np.abs(cosines - self.t) < NARROW).tolist():
            link[i, j] = exact_cosine(self.a["raw"][rows[i]], self.b["raw"][cols[j]]) >= self.t
        if self.same:
            link[rows[:, None] == cols[None, :]] = False
        self.counts[0][rows] += link @ self.b["weight"][cols]
        if not self.same:
            self.counts[1][cols] += self.a["weight"][rows] @ link
        r, c = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
        if not len(r):
            return
        link, low, high = link[np.ix_(r, c)], self.a["ids"][rows[r]], self.b["ids"][cols[c]]
        ids, others, most = low.copy(), high.copy(), np.iinfo(np.int64).max
        while True:
            up = np.minimum(low, np.where(link, high[None, :], most).min(axis=1))
            down = np.minimum(high, np.where(link, up[:, None], most).min(axis=0))
            if (up == low).all() and (down == high).all():
                break
            low, high = up, down
        self.join(ids, low)
        self.join(others, high)

    def run(self) -> None:
        a, b = self.a["tree"], self.b["tree"]
        stack = [(np.array([0]), np.array([0]))]
        while stack:
            x, y = stack.pop()
            gap = angles(self.a["unit"][a.centre[x]] @ self.b["unit"][b.centre[y]].T)
            reach = a.radius[x][:, None] + b.radius[y][None, :]
            apart = gap - reach > self.theta + SLACK
            wide = np.array([len(a.children[n]) > 0 for n in x])[:, None] | np.array([len(b.children[n]) > 0 for n in y])[None, :]
            inside = wide & (gap + reach < self.theta - SLACK)
            if self.same:
                inside &= x[:, None] != y[None, :]
            for i, j in np.argwhere(inside).tolist():
                self.whole(a, b, int(x[i]), int(y[j]))
            narrow = ~apart & ~wide
            # leaves in reach of each other are compared together, few rows of leaves at a time
            for i in np.flatnonzero(narrow.any(axis=1)).tolist():
                self.linked(a.order[slice(*a.span[x[i]])], np.concatenate([b.order[slice(*b.span[n])] for n in y[narrow[i]]]))
            for i, j in np.argwhere(wide & ~apart & ~inside).tolist():
                down_a, down_b = a.children[x[i]], b.children[y[j]]
                stack.append((down_a if len(down_a) else x[i : i + 1], down_b if len(down_b) else y[j : j + 1]))

    def whole(self, a: CoverTree, b: CoverTree, x: int, y: int) -> None:
        """All points of one node link with all points of the other."""
        rows, cols = a.order[slice(*a.span[x])], b.order[slice(*b.span[y])]
        self.counts[0][rows] += self.b["weight"][cols].sum()
        if not self.same:
            self.counts[1][cols] += self.a["weight"][rows].sum()
        ids = np.concatenate([self.a["ids"][rows], self.b["ids"][cols]])
        self.join(ids, np.full(len(ids), ids.min()))

    def result(self) -> pd.DataFrame:
        sides = [(x["ids"], c) for x, c in zip((self.a, self.b), self.counts, strict=True)][: 1 if self.same else 2]
        counted = [pd.DataFrame({"id": ids[c > 0], "n": c[c > 0], "root": -1}) for ids, c in sides]
        nodes = np.array(list(self.parent), np.int64)
        roots = np.array([find(self.parent, x) for x in self.parent], np.int64)
        moved = nodes != roots
        return pd.concat([*counted, pd.DataFrame({"id": nodes[moved], "n": 0, "root": roots[moved]})]).astype("int64").assign(forest=lambda d: d["n"] == 0)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine in double precision from exactly rounded sums."""
    import math

    a, b = a.astype(float).tolist(), b.astype(float).tolist()
    dot = math.fsum(x * y for x, y in zip(a, b, strict=True))
    return dot / math.sqrt(math.fsum(x * x for x in a) * math.fsum(x * x for x in b))


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id``, ``kept``.

    Two vectors link when their cosine in double precision is at least ``threshold`` (above 0).  ``n_links``
    counts the other rows linked directly, ``component_id`` is the smallest id reachable, ``kept`` marks it.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing, as do rows with a
    NULL id (their component is NULL); vectors of different lengths never link; repeated rows are separate vectors
    of one node; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    single = rows.schema["v"].dataType.elementType.simpleString() == "float"
    kind = np.float32 if single else np.float64
    infinite = F.lit(float("inf"))
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & F.exists("v", lambda x: x != 0)
    points = materialise(rows.filter(good).groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "points")
    found = _links(points, threshold, kind)
    found = materialise(found, "vector-links")
    counts = found.filter(~F.col("forest")).groupBy("id").agg(F.sum("n").alias("n"))
    linked = components(found.filter("forest").select("id", "root"))
    of_point = points.join(counts, "id", "left").join(linked, F.col("id") == F.col("node"), "left")
    of_point = of_point.select("v", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "id").alias("c"))
    known = spread_join(rows.filter(good), materialise(of_point, "point-verdicts"), ["v"], n="weight", by="id").select("id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    alone = rows.filter(~F.coalesce(good, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return known.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


class TooManyPairs(Exception):
    """The cells are too many, and too near to each other, to be compared on the driver."""


class Cells:
    """The cells of all rounds, on the driver: a row for each, with its centre and how far its points are from it.

    A cell is apart from another, or wholly within reach of it, if their centres and reaches say so. Only cells of
    vectors of one length are compared; those of a later round only if the cells that they are cut from are not apart.
    """

    def __init__(self, theta: float):
        self.theta, self.length, self.centre, self.facts, self.children = theta, [], [], [], {}

    def add(self, parent: int, length: int, centre: np.ndarray | None, facts: tuple) -> int:
        """``facts``: points, weight, least and most reach, smallest id."""
        self.length.append(length)
        self.centre.append(centre)
        self.facts.append(facts)
        self.children.setdefault(parent, []).append(len(self.facts) - 1)
        return len(self.facts) - 1

    def tight(self, cell: int) -> bool:
        """Whether all points of the cell link with each other."""
        return 2 * self.facts[cell][3] < self.theta - SLACK

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(pairs of cells without children that may hold links, of which both orders and each cell with itself; which of them are wholly within reach).

        More than ``MOST_PAIRS`` of them, found or yet to be looked at, are not held.
        """
        found, whole, held_pairs = [], [], 0
        for root in self.children.get(-1, []):
            roots = np.array(self.children.get(root, []), np.int64)
            held_pairs += len(roots) ** 2
            if held_pairs > MOST_PAIRS:
                raise TooManyPairs
            some = max(1, (1 << 15) // max(1, len(roots)))
            stack = [np.stack([np.repeat(x, len(roots)), np.tile(roots, len(x))], axis=1) for x in (roots[i : i + some] for i in range(0, len(roots), some))]
            centres: dict[int, np.ndarray] = {}
            while stack:
                both = stack.pop()
                if len(both) > 1 << 15:
                    stack += np.array_split(both, 1 + (len(both) >> 15))
                    continue
                if not len(both):
                    continue
                names, where = np.unique(both, return_inverse=True)
                where = where.reshape(both.shape)
                held = np.array([centres.setdefault(c, self.centre[c]) for c in names.tolist()])
                least, most = (np.array([self.facts[c][k] for c in names.tolist()]) for k in (2, 3))
                gap = angles(np.einsum("ij,ij->i", held[where[:, 0]], held[where[:, 1]]))
                gap[both[:, 0] == both[:, 1]] = 0.0
                (la, lb), (ma, mb) = least[where].T, most[where].T
                near = np.maximum(gap - ma - mb, np.maximum(lb - gap - ma, la - gap - mb)) <= self.theta + SLACK
                near |= both[:, 0] == both[:, 1]
                inner = np.array([c in self.children for c in names.tolist()])[where].any(axis=1)
                done = near & ~inner
                held_pairs -= int((~near).sum())
                found.append(both[done])
                whole.append((gap + ma + mb < self.theta - SLACK)[done])
                for a, b in both[near & inner].tolist():
                    x, y = self.children.get(a, [a]), self.children.get(b, [b])
                    held_pairs += len(x) * len(y) - 1
                    if held_pairs > MOST_PAIRS:
                        raise TooManyPairs
                    stack.append(np.stack([np.repeat(x, len(y)), np.tile(y, len(x))], axis=1))
        return (np.concatenate(found), np.concatenate(whole)) if found else (np.zeros((0, 2), np.int64), np.zeros(0, bool))


def meetings(spark: SparkSession, cells: Cells, group_of: dict[int, int]) -> DataFrame:
    """(``g``, ``h``, ``whole``): groups that may hold links with each other, both orders and each group with itself.

    Groups meet if one cell of each does. ``whole`` says of groups of one large cell each that all points link with all.
    The driver compares cells as long as few pairs are in reach. Where nothing is apart nearly every pair is, so the cells
    then go to a grid of chunks of groups, and only pairs of groups come out.
    """
    try:
        both, whole = cells.pairs()
    except TooManyPairs:
        pass
    else:
        whole &= np.array([cells.facts[c][0] > BLOCK for c in range(len(cells.facts))])[both].all(axis=1)  # these have groups of their own
        names = np.array([group_of.get(c, -1) for c in range(len(cells.facts))], np.int64)
        n = int(names.max()) + 1
        found = np.unique(2 * (names[both[:, 0]] * n + names[both[:, 1]]) + whole)
        return small_table(spark, {"g": pa.array(found // 2 // n), "h": pa.array(found // 2 % n), "whole": pa.array(found % 2 > 0)})
    theta = cells.theta
    members: dict[int, list[int]] = {}
    for c, g in group_of.items():
        members.setdefault(g, []).append(c)
    packed, width = [], []
    for held in members.values():
        facts = np.array([cells.facts[c][:4] for c in held], np.float64)
        packed.append(pickle.dumps((np.array([cells.centre[c] for c in held], np.float32), facts[:, 2], facts[:, 3], bool(facts[0, 0] > BLOCK)), protocol=5))
        width.append(cells.length[held[0]])
    table = small_table(spark, {"g": pa.array(list(members), pa.int64()), "width": pa.array(width, pa.int64()), "held": pa.array(packed, pa.binary())})
    chunk = F.floor(F.col("g") / CHUNK).cast("long")
    grid = table.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(members) // CHUNK)).cast("array<bigint>")))
    grid = grid.select("g", "width", F.least("chunk", "other").alias("c"), F.greatest("chunk", "other").alias("d"), "chunk", "held")

    def compare(pair: pd.DataFrame) -> pd.DataFrame:
        out, (c, d) = [], (pair["c"].iloc[0], pair["d"].iloc[0])
        sides = [[(g, *pickle.loads(x)) for g, x in zip(some["g"].tolist(), some["held"], strict=True)] for some in (pair[pair["chunk"] == c], pair[pair["chunk"] == d])]
        for g, centre, least, most, large in sides[0]:
            for h, others, low, high, wide in sides[1]:
                if g > h:
                    continue
                gap = angles(centre @ others.T)
                if g == h:
                    np.fill_diagonal(gap, 0.0)
                # single precision is allowed for
                near = np.maximum(gap - most[:, None] - high, np.maximum(low - gap - most[:, None], least[:, None] - gap - high)) <= theta + 1e-3
                if g == h or near.any():
                    whole = bool(large and wide and gap[0, 0] + most[0] + high[0] < theta - 1e-3)
                    out += [(g, h, whole)] if g == h else [(g, h, whole), (h, g, whole)]
        return pd.DataFrame({k: pd.Series([x[i] for x in out], dtype=t) for i, (k, t) in enumerate((("g", "int64"), ("h", "int64"), ("whole", "bool")))})

    return materialise(grid.groupBy("width", "c", "d").applyInPandas(compare, "g long, h long, whole boolean"), "groups-that-meet")


def _links(points: DataFrame, threshold: float, kind: type) -> DataFrame:
    """(id, n, root, forest): link counts and forest links among vectors of equal lengths.

    Cells of more than ``BLOCK`` points that don't all link with each other are cut again, by pivots of their own, until
    cuts no longer help; what is left of such sizes is dealt to blocks by hash. A cell wholly within reach of itself or
    of another large one needs no comparison.
    """
    spark, theta = points.sparkSession, float(np.arccos(threshold))
    cells = Cells(theta)

    def as_bytes(batches):
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
            ends = np.cumsum(batch.column(0).value_lengths().to_numpy()) * np.dtype(kind).itemsize
            vectors = [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ends) else []
            yield pa.RecordBatch.from_arrays([pa.array(vectors, pa.binary()), *batch.columns[1:]], names=["raw", "id", "weight", "cell"])

    pending = points.select("v", "id", "weight", F.size("v").cast("long").alias("cell")).mapInArrow(as_bytes, "raw binary, id long, weight long, cell long")
    # cells of the start: one for each length of vectors
    root = {r[0]: cells.add(-1, r[0], None, (r[1], 0, 0.0, np.pi, 0)) for r in points.groupBy(F.size("v")).count().orderBy(F.size("v")).collect()}
    cut, settled = {length: c for length, c in root.items()}, []
    for turn in range(ROUNDS):
        if not cut:
            break
        most = max(8, min(PIVOTS, SAMPLED // len(cut)))
        nth = F.row_number().over(W.partitionBy("cell").orderBy(F.xxhash64("id"), "id"))
        sample = pending.withColumn("nth", nth).filter(F.col("nth") <= most).select("cell", "raw").collect()  # a bounded number of rows
        rows: dict[int, list[bytes]] = {}
        for r in sample:
            rows.setdefault(r["cell"], []).append(bytes(r["raw"]))
        pivots = {}
        for key, held in rows.items():
            held = unit(np.array([np.frombuffer(x, kind) for x in sorted(held, key=zlib.crc32)]))
            kept: list[int] = []
            for i in range(len(held)):
                if not kept or angles(held[kept] @ held[i]).min() > (theta / 2 if turn == 0 else 1e-6):
                    kept.append(i)
            pivots[key] = held[kept]
        shared = spark.sparkContext.broadcast(pivots)

        def to_cells(batches, shared=shared):
            for batch in batches:
                raw, key = batch.column(0).to_pylist(), batch.column(3).to_numpy()
                nearest, level, reach = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.zeros(len(key))
                for k in np.unique(key).tolist():
                    mine = np.flatnonzero(key == k)
                    gap = angles(unit(np.frombuffer(b"".join(raw[i] for i in mine.tolist()), kind).reshape(len(mine), -1)) @ shared.value[k].T)
                    nearest[mine], reach[mine] = gap.argmin(axis=1), gap.min(axis=1)
                    level[mine] = np.clip(np.floor(np.log2(np.pi / np.maximum(reach[mine], 1e-9))), 0, LEVELS)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest), pa.array(level), pa.array(reach)], names=["raw", "id", "weight", "cell", "pivot", "level", "reach"])

        placed = materialise(pending.mapInArrow(to_cells, "raw binary, id long, weight long, cell long, pivot long, level long, reach double"), "cells")
        facts = placed.groupBy("cell", "pivot", "level").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.min("reach").alias("least"), F.max("reach").alias("most"), F.min("id").alias("first"))
        made, following = [], {}
        # a bounded number of cells for each that was cut, a batch of them as Python objects at a time
        for r in (r for batch in facts.orderBy("cell", "pivot", "level").toArrow().to_batches(1_024) for r in batch.to_pylist()):
            parent = cut[r["cell"]]
            new = cells.add(parent, cells.length[parent], pivots[r["cell"]][r["pivot"]], (r["n"], r["w"], r["least"], r["most"], r["first"]))
            again = r["n"] > BLOCK and not cells.tight(new) and r["n"] <= 0.9 * cells.facts[parent][0] and turn + 1 < ROUNDS
            made.append((r["cell"], r["pivot"], r["level"], new, again))
            if again:
                following[new] = new
        named = small_table(spark, {n: pa.array([m[i] for m in made], t) for i, (n, t) in enumerate((("cell", pa.int64()), ("pivot", pa.int64()), ("level", pa.int64()), ("new", pa.int64()), ("again", pa.bool_())))})
        named = placed.join(F.broadcast(named) if len(made) <= BROADCAST_IDS else named, ["cell", "pivot", "level"]).select("raw", "id", "weight", F.col("new").alias("cell"), "again")
        settled.append(named.filter(~F.col("again")).drop("again"))
        pending, cut = named.filter("again").drop("again"), following
    if not root:
        return spark.createDataFrame([], "id long, n long, root long, forest boolean")
    table = settled[0]
    for more in settled[1:]:
        table = table.union(more)
    leaves = [c for c in range(len(cells.facts)) if cells.centre[c] is not None and c not in cells.children]
    # packed into groups of vectors of one length, or one group of several blocks when large
    group_of, group, held, before = {}, -1, BLOCK, None
    for c in sorted(leaves, key=lambda c: (cells.length[c], c)):
        n = cells.facts[c][0]
        if held + n > BLOCK or cells.length[c] != before:
            group, held, before = group + 1, 0, cells.length[c]
        group_of[c] = group
        held += n
    sizes = np.bincount([group_of[c] for c in leaves], [cells.facts[c][0] for c in leaves]).astype(int)
    blocks = np.ceil(sizes / BLOCK).astype(int)
    meet = meetings(spark, cells, group_of)
    partners, whole = meet.filter("NOT whole").select("g", "h"), meet.filter("whole")
    met_wholly = not whole.isEmpty()
    # blocks are numbered through; chunks of them hold vectors of one length
    first = np.concatenate([[0], np.cumsum(blocks)])
    width = np.zeros(len(sizes), np.int64)
    for c in leaves:
        width[group_of[c]] = cells.length[c]
    of_group = np.array([group_of[c] for c in leaves], np.int64)
    groups = small_table(spark, {"cell": pa.array(leaves, pa.int64()), "grp": pa.array(of_group), "blocks": pa.array(blocks[of_group], pa.int64()), "first": pa.array(first[of_group], pa.int64()), "width": pa.array(width[of_group])})

    def build(block: pd.DataFrame) -> pd.DataFrame:
        raw = np.frombuffer(b"".join(block["raw"]), kind).reshape(len(block), -1)
        points = unit(raw)
        tree = CoverTree(points)
        packed = pickle.dumps((raw, block["id"].to_numpy(), block["weight"].to_numpy(), tree), protocol=5)
        top = tree.frontier(theta / 4)
        nodes = pickle.dumps((points[tree.centre[top]].astype(np.float32), tree.radius[top]), protocol=5)
        return block[["at", "grp", "width"]].iloc[:1].assign(block=[packed], nodes=[nodes])

    bounded = lambda df, n: F.broadcast(df) if n <= BROADCAST_IDS else df
    needed = groups.join(partners.select(F.col("g").alias("grp")).distinct(), "grp", "left_semi")
    dealt = table.join(bounded(needed, len(leaves)), "cell").withColumn("at", F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks")))
    trees = materialise(dealt.select("at", "grp", "width", "raw", "id", "weight").groupBy("at").applyInPandas(build, "at long, grp long, width long, block binary, nodes binary"), "cover-trees")

    def pack(chunk: pd.DataFrame) -> pd.DataFrame:
        parts = [pickle.loads(x) for x in chunk["nodes"]]
        owner = np.repeat(chunk["at"].to_numpy(), [len(p[1]) for p in parts])
        group = np.repeat(chunk["grp"].to_numpy(), [len(p[1]) for p in parts])
        held = pickle.dumps((np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), owner, group), protocol=5)
        return chunk[["width", "chunk"]].iloc[:1].assign(held=[held])

    def reached(pair: pd.DataFrame) -> pd.DataFrame:
        """Pairs of blocks with nodes in reach of each other; single precision is allowed for."""
        a, b = (pickle.loads(pair["held"].iloc[k]) for k in (0, -1))
        found = [np.zeros((0, 4), np.int64)]
        for i in range(0, len(a[0]), NODES):
            some = slice(i, i + NODES)
            near = angles(a[0][some] @ b[0].T) - a[1][some, None] - b[1][None, :] <= theta + 1e-3
            x, y = np.nonzero(near)
            found.append(np.unique(np.stack([a[2][some][x], b[2][y], a[3][some][x], b[3][y]], axis=1), axis=0))
        found = np.unique(np.concatenate(found), axis=0)
        turned = found[:, 0] > found[:, 1]
        found[turned] = found[turned][:, [1, 0, 3, 2]]
        return pd.DataFrame(np.unique(found, axis=0), columns=["one", "two", "g", "h"])

    chunked = trees.select("at", "grp", "width", "nodes", F.floor(F.col("at") / CHUNK).cast("long").alias("chunk"))
    chunks = materialise(chunked.groupBy("width", "chunk").applyInPandas(pack, "width long, chunk long, held binary"), "tree-nodes")
    last = int(first[-1] // CHUNK)
    grid = chunks.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(last)).cast("array<bigint>")))
    grid = grid.select("width", F.least("chunk", "other").alias("c"), F.greatest("chunk", "other").alias("d"), "held")
    near = grid.groupBy("width", "c", "d").applyInPandas(lambda pair: reached(pair) if len(pair) > 1 or pair["c"].iloc[0] == pair["d"].iloc[0] else pd.DataFrame({x: pd.Series([], dtype="int64") for x in ("one", "two", "g", "h")}), "one long, two long, g long, h long")
    near = materialise(near.join(bounded(partners, len(sizes) ** 2), ["g", "h"], "left_semi").select("one", "two").distinct(), "near-blocks")
    # neighbouring blocks travel together: a task holds some of both sides and walks all their pairs
    some = max(1, min(TOGETHER, int(first[-1]) // 32))
    of = lambda at: F.floor(F.col(at) / some).cast("long")
    asked = near.select(of("one").alias("i"), of("two").alias("j"), "one", "two")
    parts = asked.select("i", "j", F.explode(F.array("one", "two")).alias("at")).distinct().join(trees.select("at", "block"), "at")
    none = lambda kind: F.lit(None).cast(kind)
    met = asked.select("i", "j", "one", "two", none("long").alias("at"), none("binary").alias("block")).union(parts.select("i", "j", none("long").alias("one"), none("long").alias("two"), "at", "block"))

    def unpack(raw: bytes) -> dict:
        vectors, ids, weight, tree = pickle.loads(raw)
        return {"raw": vectors, "unit": unit(vectors), "ids": ids, "weight": weight, "tree": tree}

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        pairs, blocks = rows[rows["at"].isna()], rows[rows["at"].notna()]
        held = {int(at): unpack(block) for at, block in zip(blocks["at"], blocks["block"], strict=True)}
        found = []
        for one, two in zip(pairs["one"].astype("int64").tolist(), pairs["two"].astype("int64").tolist(), strict=True):
            dual = Dual(held[one], held[two], threshold, one == two)
            dual.run()
            found.append(dual.result())
        return pd.concat(found).groupby(["id", "root", "forest"], as_index=False)["n"].sum()[["id", "n", "root", "forest"]]

    walked = met.groupBy("i", "j").applyInPandas(walk, "id long, n long, root long, forest boolean")
    return walked.union(_whole(table, cells, group_of, whole)) if met_wholly else walked


def _whole(table: DataFrame, cells: Cells, group_of: dict[int, int], pairs: DataFrame) -> DataFrame:
    """Links of large cells wholly within each other's reach: every point with every other, counted by the cells' weights.

    All points of such a cell are in one component, by way of its partner, and stand with their cell's smallest id.
    """
    large = [c for c in group_of if cells.facts[c][0] > BLOCK]
    facts = small_table(table.sparkSession, {
        "cell": pa.array(large, pa.int64()), "g": pa.array([group_of[c] for c in large], pa.int64()),
        "held": pa.array([cells.facts[c][1] for c in large], pa.int64()), "root": pa.array([cells.facts[c][4] for c in large], pa.int64()),
    })
    linked = pairs.select("g", "h").join(facts, "g").join(facts.select(F.col("g").alias("h"), F.col("held").alias("others"), F.col("root").alias("to")), "h")
    named = linked.groupBy("cell", "root").agg(F.sum("others").alias("n"), F.max(F.col("g") == F.col("h")).alias("own"))
    rows = table.join(F.broadcast(named) if len(large) <= BROADCAST_IDS else named, "cell")
    counted = rows.select("id", (F.col("n") - F.when(F.col("own"), F.col("weight")).otherwise(0)).alias("n"), F.lit(-1).cast("long").alias("root"), F.lit(False).alias("forest"))
    tree = lambda df, a, b: df.filter(F.col(a) != F.col(b)).select(F.col(a).alias("id"), F.lit(0).cast("long").alias("n"), F.col(b).alias("root"), F.lit(True).alias("forest"))
    return counted.union(tree(rows, "id", "root")).union(tree(linked, "root", "to"))
