"""Exact Jaccard self-join of word shingles by prefix filters under several global orders.

Two sets whose Jaccard similarity reaches the threshold share a token among
their first few tokens under *any* total order.  So a pair has to pass under
each of ``ORDERS`` orders before its sets are compared:

* orders 1 and 2 take rare tokens first (a frequency class from a counting
  sketch of all texts), each with its own hash inside a class;
* order 3 is a pure hash order.

Order 1 makes the posting lists.  Documents with equal sets are one class
beforehand.  Every document is first compared with up to four leaders of each of
its lists, which costs a few times the lists' length, and only longer lists that
still hold documents of different components are compared in full, in blocks of
bounded size and never as emitted pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, IdFilter, discard, drop_rows, materialise, positional, release, spread_join
from .components import components, find
from .kernels import mix, shingle_sets, slices, trim

ORDERS = 3
#: Counters of the frequency sketch; one byte of each is broadcast.
SKETCH = 1 << 20
#: Tokens that a task gathers before it counts them.
GATHERED = 2_000_000
#: Documents compared with one leader at a time.
LEADER_BLOCK = 64
#: Tokens of either side of a block (8 bytes each).
BLOCK_TOKENS, MINOR_TOKENS = 500_000, 200_000


def prefix_length(n: int, num: int, den: int) -> int:
    """A partner at the threshold shares at least ceil(n * num / den) of n tokens."""
    return n - (n * num + den - 1) // den + 1


def prefix(tokens: np.ndarray, order: int, length: int, classes: np.ndarray) -> np.ndarray:
    """The first ``length`` tokens under global order 1, 2 or 3."""
    rank = mix(tokens, order)
    if order < ORDERS:
        rank = (rank >> np.uint64(8)) | (classes[bucket(tokens)].astype(np.uint64) << np.uint64(56))
    return tokens[np.argpartition(rank, length - 1)[:length]] if length < len(tokens) else tokens


def bucket(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens, 77) & np.uint64(SKETCH - 1)).astype(np.int64)


def _sets(batch: pa.RecordBatch, width: int, wanted=None):
    """(row, set) for each row whose third column ``wanted`` lets pass."""
    rows = range(batch.num_rows) if wanted is None else np.flatnonzero(wanted(batch.column(2).to_numpy(zero_copy_only=False))).tolist()
    picked = batch.column(1) if wanted is None else batch.column(1).take(pa.array(rows, pa.int64()))
    yield from zip(rows, shingle_sets(picked, width), strict=True)


def _counted(gathered: list[np.ndarray]):
    """Rows for tokens that repeat among the gathered sets: bucket and count."""
    tokens, counts = np.unique(np.concatenate(gathered), return_counts=True) if gathered else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    often = counts > 1
    where, counts = bucket(tokens[often]), counts[often]
    totals = np.bincount(where, counts) if len(where) else np.zeros(0)
    used = np.flatnonzero(totals)
    return used, totals[used].astype(np.int64)


def summarise(docs: DataFrame, width: int) -> DataFrame:
    """Rows (id, n, f1, f2) of set size and fingerprint, and rows (bucket, count, NULL, NULL) of the sketch, marked by ``doc``."""

    def scan(batches):
        gathered, held = [], 0
        names = ["doc", "id", "n", "f1", "f2"]

        def counts():
            used, totals = _counted(gathered)
            nulls = pa.nulls(len(used), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(used), bool)), pa.array(used), pa.array(totals), nulls, nulls], names=names)

        for batch in slices(batches, 1):
            n, f1, f2 = [], [], []
            for _, tokens in _sets(batch, width):
                n.append(len(tokens))
                f1.append(np.bitwise_xor.reduce(mix(tokens, 91)).view(np.int64) if len(tokens) else 0)
                f2.append(np.add.reduce(mix(tokens, 92)).view(np.int64) if len(tokens) else 0)
                gathered.append(tokens)
                held += len(tokens)
                if held >= GATHERED:
                    yield counts()
                    gathered, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), bool)), batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64())], names=names)
        yield counts()

    return docs.mapInArrow(scan, "doc boolean, id long, n long, f1 long, f2 long")


def frequency_classes(summary: DataFrame) -> np.ndarray:
    """One byte per counter: the binary logarithm of its count. Always ``SKETCH`` bytes."""
    rows = summary.filter(~F.col("doc")).groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SKETCH, np.int64)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return np.ceil(np.log2(counts + 1)).astype(np.uint8)


def prefixes(docs: DataFrame, width: int, num: int, den: int, classes: Broadcast) -> DataFrame:
    """(id, set size, prefix under order 1) of every document with a set."""

    def scan(batches):
        for batch in slices(batches, 1):
            ids, sizes, found = [], [], []
            source = batch.column(0).to_pylist()
            for row, tokens in _sets(batch, width):
                if len(tokens) and source[row] is not None:
                    ids.append(source[row])
                    sizes.append(len(tokens))
                    found.append(prefix(tokens, 1, prefix_length(len(tokens), num, den), classes.value).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), _lists(found)], names=["id", "n", "tokens"])

    return docs.mapInArrow(scan, "id long, n long, tokens array<long>")


def in_lists(prefixes: DataFrame, lists: DataFrame) -> DataFrame:
    """(id, n, token) of the prefixes' tokens that ``lists`` holds, and a few more: the rest needn't be shuffled again."""
    passing = IdFilter(lists.select(F.col("token").alias("id")))
    at = F.transform("tokens", lambda t: F.pmod(F.xxhash64(t), F.lit(passing.bits)))

    def scan(batches):
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            hit = passing.wanted(batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            row = np.repeat(np.arange(batch.num_rows), sizes)[hit]
            token = batch.column(2).flatten().to_numpy(zero_copy_only=False)[hit]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(token)], names=["id", "n", "token"])

    return prefixes.select("id", "n", "tokens", at.alias("at")).mapInArrow(scan, "id long, n long, token long")


def long_prefix(n: int, num: int, den: int) -> tuple[int, int]:
    """Length of order 3's prefix and how many of its tokens a partner must share: L = n - alpha + l holds l shared ones."""
    short = prefix_length(n, num, den)
    need = max(1, min(n - short + 1, short))
    return short - 1 + need, need


def fetch(docs: DataFrame, ids: DataFrame, width: int, num: int, den: int, classes: Broadcast, whole: bool) -> DataFrame:
    """(id, n, set) of the documents in ``ids``, and of a few more, or else (id, n, p2, p3, need) for the filters; texts are not shuffled.

    The filters' tokens are cut to 32 bits: a collision can only let a pair through.
    """
    passing = IdFilter(ids)
    cut = lambda tokens: (tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)

    def scan(batches):
        for batch in slices(batches, 1):
            ids, sizes, sets, p2, p3, needs = [], [], [], [], [], []
            source = batch.column(0).to_pylist()
            for row, tokens in _sets(batch, width, passing.wanted):
                if len(tokens) and source[row] is not None:
                    ids.append(source[row])
                    sizes.append(len(tokens))
                    if whole:
                        sets.append(tokens.tobytes())
                    else:
                        length, need = long_prefix(len(tokens), num, den)
                        p2.append(cut(prefix(tokens, 2, prefix_length(len(tokens), num, den), classes.value)))
                        p3.append(cut(prefix(tokens, 3, length, classes.value)))
                        needs.append(need)
            head = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())]
            if whole:
                yield pa.RecordBatch.from_arrays([*head, pa.array(sets, pa.binary())], names=["id", "n", "tokens"])
            else:
                yield pa.RecordBatch.from_arrays([*head, _lists(p2, np.int32), _lists(p3, np.int32), pa.array(needs, pa.int32())], names=["id", "n", "p2", "p3", "need"])

    schema = "id long, n long, tokens binary" if whole else "id long, n long, p2 array<int>, p3 array<int>, need int"
    return docs.select("id", "text", passing.column().alias("at")).mapInArrow(scan, schema)


def _lists(parts: list[np.ndarray], kind: type = np.int64) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, kind)))


def if_small(rows: DataFrame) -> DataFrame:
    """A materialised table of ids and flags, broadcast rather than shuffling sets twice if it has at most ``BROADCAST_IDS`` rows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


class _Flat:
    """Token arrays of several documents as codes in one array."""

    def __init__(self, parts: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in parts])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        values, self.codes = np.unique(np.concatenate(parts), return_inverse=True)
        self.flags = np.zeros(len(values), bool)

    def of(self, i: int) -> np.ndarray:
        return self.codes[self.starts[i] : self.starts[i] + self.sizes[i]]

    def shared(self, i: int) -> np.ndarray:
        """Tokens that each document shares with document ``i``."""
        mine = self.of(i)
        self.flags[mine] = True
        out = np.add.reduceat(self.flags[self.codes], self.starts, dtype=np.int64)
        self.flags[mine] = False
        return out


def _compared(block: pd.DataFrame) -> pd.DataFrame:
    return block.sort_values("first", ascending=False).drop_duplicates("id") if block["id"].duplicated().any() else block


def survivors(block: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """The rows of a block that pass the filters of orders 2 and 3 with a row of another component, one of the two marked ``first``."""
    block = _compared(block)
    p2, p3 = _Flat(block["p2"].tolist()), _Flat(block["p3"].tolist())
    n, label, need = (block[c].to_numpy() for c in ("n", "component", "need"))
    passed = np.zeros(len(block), bool)
    for i in np.flatnonzero(block["first"].to_numpy()).tolist():
        other = (label != label[i]) & (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i]))
        for flat, least in ((p2, 1), (p3, np.minimum(need, need[i]))):
            if other.any():
                other &= flat.shared(i) >= least
        passed |= other
        passed[i] |= other.any()
    trim()
    return block.loc[passed, ["unit", "part", "id", "component", "first"]]


def verify(block: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Links of the rows marked ``first`` with rows of other components, as a spanning forest of the components.

    What has been joined isn't compared again.
    """
    block = _compared(block)
    ids, label, n = block["id"].tolist(), block["component"].to_numpy(), block["n"].to_numpy()
    sets = _Flat([np.frombuffer(x, np.uint64) for x in block["tokens"]])
    parent: dict[int, int] = {}
    roots, links = label.copy(), []
    for i in np.flatnonzero(block["first"].to_numpy()).tolist():
        other = (roots != roots[i]) & (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i]))
        if not other.any():
            continue
        both = sets.shared(i)
        other &= den * both >= num * (n + n[i] - both)
        for j in np.flatnonzero(other).tolist():
            a, b = find(parent, int(label[i])), find(parent, int(label[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((ids[i], ids[j]))
        if other.any():
            roots = np.array([find(parent, int(x)) for x in label])
    trim()
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def join_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``.

    A document's set holds its distinct shingles of ``width`` words (words: runs
    of anything but ASCII blanks, A-Z lower-cased); a shorter text is one
    shingle.  Two documents link when ``den * intersection >= num * union``, and
    ``component_id`` is the smallest id reachable by links.  Shingles are
    compared as 64-bit hashes.

    NULL, empty and blank texts have an empty set and link with nothing; rows
    that repeat an id are one node; a NULL id links with nothing and gets a NULL
    component; very long texts are read whole; an empty table gives no rows;
    other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    num, den = threshold
    light = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    summary = materialise(summarise(light, width), "shingle-sets")
    classes = spark.sparkContext.broadcast(frequency_classes(summary))
    rows = summary.filter("doc").drop("doc")
    groups = materialise(rows.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("head"), F.count("*").alias("copies")), "equal-sets")
    heads = groups.select(F.col("head").alias("id")).distinct()

    first = materialise(prefixes(light, width, num, den, classes).join(heads, "id", "left_semi"), "prefixes")
    postings = first.select("id", "n", F.explode("tokens").alias("token"))
    lists = postings.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1").select("token")
    lists = materialise(lists, "shared-lists")
    shared = materialise(in_lists(first, lists).join(lists, "token"), "shared-tokens")
    discard(first)
    release(spark)

    # similar sets have similar sizes: a list is dealt to bands of sizes, each document to its own and the next
    step = 1.001 * math.log(den / num)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(step))
    banded = shared.select("token", "id", "n", F.explode(F.array(band, band + 1)).alias("band"))
    one, hashed = F.struct("id", "n"), F.struct(F.xxhash64("id").alias("h"), F.struct("id", "n").alias("one"))
    leaders = banded.groupBy("token", "band").agg(F.count("*").alias("size"), F.min(one).alias("l1"), F.max(one).alias("l2"), F.min(hashed)["one"].alias("l3"), F.max(hashed)["one"].alias("l4")).filter("size > 1")
    leaders = leaders.select("token", "band", "size", F.array_distinct(F.array("l1", "l2", "l3", "l4")).alias("leaders"))
    leaders = materialise(leaders, "list-leaders")
    listed = leaders.filter("size > 2").withColumn("rows", F.col("size"))
    banded = materialise(spread_join(banded, listed, ["token", "band"], n="rows", by="id"), "banded-lists")
    discard(shared)

    # every document against the leaders of its lists, first under the other orders, then by sets
    of_two = leaders.filter("size = 2").select(F.get("leaders", F.lit(0)).alias("l"), F.get("leaders", F.lit(1)).alias("i"))  # one row repeated has no second
    pairs = banded.select(F.struct("id", "n").alias("i"), F.explode("leaders").alias("l")).unionByName(of_two)
    pairs = pairs.select(F.col("i.id").alias("id"), F.col("i.n").alias("n"), F.col("l.id").alias("leader"), F.col("l.n").alias("m"))
    alike = F.lit(den) * F.least("n", "m") >= F.lit(num) * F.greatest("n", "m")
    pairs = materialise(pairs.filter("id <> leader").filter(alike).groupBy(F.least("id", "leader").alias("low"), F.greatest("id", "leader").alias("high")).agg(F.min("leader").alias("leader")), "leader-pairs")
    pairs = pairs.select("leader", F.when(F.col("leader") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("id"))
    other = materialise(fetch(light, pairs.select("id").union(pairs.select("leader")).distinct(), width, num, den, classes, False), "other-orders")
    led = pairs.groupBy("leader").agg(F.count("*").alias("rows"))
    lead = other.select(F.col("id").alias("leader"), F.col("p2").alias("l2"), F.col("p3").alias("l3"), F.col("need").alias("l_need"))
    led = materialise(led, "led")
    lead = materialise(lead.join(if_small(led), "leader"), "leaders")
    enough = F.size(F.array_intersect("p3", "l3")) >= F.least("need", "l_need")
    met = spread_join(other.join(if_small(pairs), "id"), lead, ["leader"], n="rows", by="id")
    passed = materialise(met.filter(F.arrays_overlap("p2", "l2") & enough).select("leader", "id").distinct(), "passed-pairs")
    discard(other, lead, led)
    release(spark)
    salts = materialise(passed.groupBy("leader").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / LEADER_BLOCK).alias("salts")), "leader-salts")
    salted = spread_join(passed, salts, ["leader"], n="rows", by="id").select("leader", "id", F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"))
    members = salted.select("leader", "salt", "id", F.lit(False).alias("first")).union(salted.select("leader", "salt", F.col("leader").alias("id"), F.lit(True)).distinct())
    members = materialise(members.withColumn("component", F.col("id")), "leader-blocks")
    sets = fetch(light, members.select("id").distinct(), width, num, den, classes, True)
    near = sets.join(if_small(members), "id").groupBy("leader", "salt").applyInPandas(lambda block: verify(block, num, den), "a long, b long")
    near = materialise(near, "leader-links")
    found = materialise(components(near), "leader-components")
    release(spark)

    # lists that are not wholly compared by that and still hold several components: all against those outside the largest
    node, component = F.col("node"), F.coalesce("component", "id").alias("component")
    labelled = banded.filter(F.col("size") > F.size("leaders") + 1).join(found, banded["id"] == node, "left").select("token", "band", "id", component)
    labelled = materialise(labelled, "labelled-lists")
    per = labelled.groupBy("token", "band", "component").agg(F.count("*").alias("c"))
    largest = per.groupBy("token", "band").agg(F.max(F.struct("c", (-F.col("component")).alias("k")))["k"].alias("k"), F.count("*").alias("several"), F.sum("c").alias("rows")).filter("several > 1")
    # lists with the same largest component are compared once, together
    open_rows = spread_join(labelled, materialise(largest.drop("several"), "open-largest"), ["token", "band"], n="rows", by="id").select((-F.col("k")).alias("largest"), "band", "id", "component").distinct()
    open_rows = materialise(open_rows.withColumn("minor", F.col("component") != F.col("largest")), "open-lists")
    tokens = F.exp((F.col("band") + 1) * F.lit(step))  # no set of the band has more
    blocks = open_rows.groupBy("largest", "band").agg(F.count("*").alias("rows"), F.ceil(F.count("*") * tokens / BLOCK_TOKENS).alias("blocks"), F.ceil(F.count_if("minor") * tokens / MINOR_TOKENS).alias("minors"))
    blocked = spread_join(open_rows, materialise(blocks, "open-sizes"), ["largest", "band"], n="rows", by="id")
    h, upto = F.xxhash64("id"), lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    sides = [
        blocked.select("largest", "band", "id", "component", F.lit(False).alias("first"), F.pmod(h, F.col("blocks")).alias("x"), upto("minors").alias("y")),
        blocked.filter("minor").select("largest", "band", "id", "component", F.lit(True).alias("first"), upto("blocks").alias("x"), F.pmod(h, F.col("minors")).alias("y")),
    ]
    units = materialise(sides[0].union(sides[1]).select(F.struct("largest", "band").alias("unit"), F.struct("x", "y").alias("part"), "id", "component", "first"), "open-blocks")
    filters = fetch(light, units.select("id").distinct(), width, num, den, classes, False)
    left = filters.join(if_small(units), "id").groupBy("unit", "part").applyInPandas(lambda block: survivors(block, num, den), units.schema)
    left = materialise(left, "open-survivors")
    release(spark)
    sets = fetch(light, left.select("id").distinct(), width, num, den, classes, True)
    far = sets.join(if_small(left), "id").groupBy("unit", "part").applyInPandas(lambda block: verify(block, num, den), "a long, b long")
    linked = components(near.union(far))
    discard(leaders, banded, passed, salts, members, near, found, labelled, open_rows, units, left)

    # by then one row for each set: the copies of a set are dealt out, and rows without a set need no join
    of_set = materialise(groups.join(linked, F.col("head") == F.col("node"), "left").select("n", "f1", "f2", "copies", F.coalesce("component", "head").alias("component")), "set-components")
    held = spread_join(rows.filter("n > 0"), of_set, ["n", "f1", "f2"], n="copies", by="id").select("id", "n", F.coalesce("component", "id").alias("component"))
    of_row = held.union(rows.filter("n = 0").select("id", "n", F.col("id").alias("component")))
    return of_row.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows whose id is the smallest of its group of near copies.

    Of rows that repeat both id and text one stays, the least by a hash of all its columns; rows that repeat an id
    with another text all stay or go together.  Rows with a NULL id, and rows without words, all stay.  An empty
    table gives no rows; other columns may have any names and stay as they are.
    """
    verdict = materialise(join_similar(docs, id_col=id_col, text_col=text_col, **options), "near-verdict")
    kept = drop_rows(docs, verdict.filter(F.col("component_id") < F.col(id_col)).select(id_col), id_col)
    repeated = materialise(verdict.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(id_col), "repeated-ids")
    if repeated.isEmpty():
        return kept
    plain, names = positional(kept)
    several = plain.join(repeated.toDF("__id"), F.col(names[id_col]) == F.col("__id"), "left_semi")
    first = F.row_number().over(W.partitionBy(names[id_col], names[text_col]).orderBy(F.xxhash64(*names.values())))
    several = several.withColumn("__nth", first).filter("__nth = 1").drop("__nth").toDF(*kept.columns)
    return drop_rows(kept, repeated, id_col).union(several)
