"""Maximal periodic runs of words, and texts without their repeats.

A run of period p and three times its length holds two neighbouring blocks
[kp, kp + p) and [kp + p, kp + 2p) of the grid of p.  All (period, grid point)
pairs of a text, about n ln n of them, are compared at once with prefix hashes;
where blocks agree, one binary search for all of them finds how far the
agreement goes both ways.  Words of every run found so are compared; should a
hash have lied, the same search runs again on exact tables.

No row needs another: one pass over the texts, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .kernels import binaries, hashed_words, powers, slices

#: A run has at least so many words and so many times its period.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: (period, grid point) pairs that are looked at together.
PAIRS = 1 << 21

#: Whether the words [i, i + m) and [j, j + m) agree, for arrays of i < j and m > 0.
Same = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def by_hash(words: np.ndarray) -> Same:
    """Equality by prefix hashes of the words' hashes. Equal stretches always agree, unequal ones hardly ever."""
    up = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    return lambda i, j, m: (sums[i + m] - sums[i]) * up[j - i] == sums[j + m] - sums[j]


def by_rank(words: list[bytes]) -> Same:
    """Exact equality: ranks of all stretches of 1, 2, 4, ... words, two of which cover any stretch."""
    ids: dict[bytes, int] = {}
    ranks = [np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)]
    while 2 << len(ranks) - 1 <= len(words):
        last, half = ranks[-1], 1 << len(ranks) - 1
        ranks.append(np.unique(last[:-half] * len(words) + last[half:], return_inverse=True)[1].astype(np.int64))
    first = np.cumsum([0, *map(len, ranks)])
    flat = np.concatenate(ranks)

    def same(i: np.ndarray, j: np.ndarray, m: np.ndarray) -> np.ndarray:
        level = np.frexp(m.astype(np.float64))[1] - 1
        at, rest = first[level], m - (1 << level)
        return (flat[at + i] == flat[at + j]) & (flat[at + i + rest] == flat[at + j + rest])

    return same


def grid(n: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, grid point) pairs of a text of ``n`` words, ordered by both, about ``PAIRS`` at a time."""
    periods = np.arange(1, n // times + 1)
    ends = np.cumsum(n // periods - 1)
    done = 0
    while done < len(periods):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, side="right")))
        some = periods[done:upto]
        each = n // some - 1
        period = np.repeat(some, each)
        yield period, (np.arange(len(period)) - np.repeat(np.cumsum(each) - each, each)) * period
        done = upto


def longest(test: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each place the largest m in [low, high] that passes: ``low`` does, and so does all below one that does."""
    low, high = low.copy(), high.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        good = test(middle) | (low >= high)
        low, high = np.where(good, np.minimum(middle, high), low), np.where(good, high, middle - 1)
    return low


def search(values: np.ndarray, same: Same, least: int, times: int) -> tuple[np.ndarray, bool]:
    """Rows (start, end, period) of all runs, by start and period; and whether every agreement that led to one was explained."""
    n, rows, sound = len(values), [], True
    for period, at in grid(n, times):
        near = np.flatnonzero(values[at] == values[at + period])
        period, at = period[near], at[near]
        held = same(at, at + period, period)
        period, at = period[held], at[held]
        if not len(at):
            continue
        # neighbours on the grid that all agree belong to one stretch: its first one speaks for them
        head = np.ones(len(at), bool)
        head[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + period[1:])
        last = at[np.append(np.flatnonzero(head)[1:] - 1, len(at) - 1)]
        period, at = period[head], at[head]
        ahead = longest(lambda m: same(at, at + period, m), period, n - at - period)
        behind = longest(lambda m: (m == 0) | same(at - m, at + period - m, np.maximum(m, 1)), np.zeros_like(at), np.minimum(at, period))
        sound &= bool((last + 2 * period <= at + period + ahead).all())
        rows.append(np.stack([at - behind, at + period + ahead, period], axis=1))
    if not rows:
        return np.zeros((0, 3), np.int64), sound
    found = np.concatenate(rows)
    found = found[found[:, 1] - found[:, 0] >= np.maximum(least, times * found[:, 2])]
    # a multiple of the smallest period gives the same stretch
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[fresh]
    return found[np.lexsort((found[:, 2], found[:, 0]))], sound


def runs_of(words: list[bytes], hashes: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> np.ndarray:
    """Rows (start, end, smallest period) of the maximal runs of a text, by start and period."""
    if len(words) < max(least, times):
        return np.zeros((0, 3), np.int64)
    found, sound = search(hashes, by_hash(hashes), least, times)
    if sound and all(words[s : e - p] == words[s + p : e] for s, e, p in found.tolist()):
        return found
    same = by_rank(words)
    ids: dict[bytes, int] = {}
    return search(np.array([ids.setdefault(w, len(ids)) for w in words]), same, least, times)[0]


def collapse(words: list[bytes], found: np.ndarray) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if len(found):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, found[:, 0] + found[:, 2], 1)
        np.add.at(edge, found[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    return b" ".join(words)


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", *, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """(key, ``n_words``, ``runs``, ``collapsed``): every maximal run of each text as (start, length, period), by start and
    period, and the text without its repeats.

    Words are runs of anything but ASCII blanks, compared byte by byte. A run has at least ``least`` words and ``times``
    its smallest period (three or more). NULL and empty texts have no words, no runs and an empty collapsed text;
    repeated rows and NULL keys are rows like any other; other columns are ignored; an empty table gives no rows.
    """
    if times < 3 or least < 1:
        raise ValueError("times must be at least 3 and least positive")
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            hashes, first = hashed_words(batch.column(1), False)
            sizes, rows, texts = [], [], []
            for i, raw in enumerate(binaries(batch.column(1))):
                words = (raw or b"").split()
                found = runs_of(words, hashes[first[i] : first[i + 1]], least, times)
                sizes.append(len(words))
                rows.append([{"start": s, "length": e - s, "period": p} for s, e, p in found.tolist()])
                texts.append(collapse(words, found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(rows, run), pa.array(texts, pa.binary())], names=["key", "n_words", "runs", "collapsed"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(scan, f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return out.select(F.col("key").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first. NULL without any."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def repeat_tail(text: Column, n: Column, first: Column, period: Column, word: str) -> Column:
    """The ``n`` words of a text joined by one space, where from word ``first`` on the next ``period`` words repeat to the end."""
    words = F.regexp_extract_all(text, F.lit(word), F.lit(0))
    again = F.flatten(F.array_repeat(F.slice(words, first + 1, period), F.ceil((n - first) / period).cast("int")))
    return F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), first), again), F.lit(1), n), " ")
