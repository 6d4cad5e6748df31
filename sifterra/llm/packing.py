"""Pack documents into sequences of a fixed length, each window filled with lexical neighbours.

A document's whole windows need no neighbour and are cut at once.  What is left
of each document goes to shards: rows are range-partitioned by a minimum hash
over the words of the whole document, so texts that share words meet, and every
run of ``SHARD`` rows is a shard with a BM25 index of its own, over whole
documents too.  A window starts with a seed, the index returns its unused
neighbours, all of them if need be, and they fill the window in the order of
their scores; the last one is cut where the window ends, and its rest is the
next window's seed.  Only the last window of a partition can fall short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import spread, tokens
from .common import materialise, partitions
from .kernels import flat_bytes, slices, trim

WINDOW = 1024
#: Most documents that are indexed together, and about the most postings of such a shard.
SHARD, POSTINGS = 2_048, 1_000_000
#: A term of more documents is a row of a dense table.
DENSE = 128
#: Postings that are weighed at a time.
BLOCK = 1 << 16
#: Neighbours that are put in order at first; the others follow if these do not fill the window.
FIRST = 16
K1, B = 1.5, 0.75


class Shard:
    """BM25 over the words of a few thousand rows."""

    def __init__(self, terms: np.ndarray, times: np.ndarray, held: np.ndarray):
        """``terms``: distinct 32-bit terms of a row, row after row; ``times``: how often; ``held``: how many terms a row has.

        Postings are in narrow types, and each array goes once it is used: a worker has several at its peak.
        """
        n = len(held)
        first = np.concatenate([[0], np.cumsum(held)])
        length = np.diff(np.concatenate([[0], np.cumsum(times, dtype=np.int64)])[first]).astype(np.float64)
        norm = K1 * (1 - B + B * length / max(1e-9, length.mean()))
        keys = terms.astype(np.uint64)
        keys <<= np.uint64(32)
        keys |= np.arange(len(terms), dtype=np.uint32)
        keys.sort()
        order = keys.astype(np.uint32)
        keys >>= np.uint64(32)
        fresh = np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])
        del keys
        df = np.diff(np.append(np.flatnonzero(fresh), len(terms)))
        # a term of one row leads nowhere
        order = order[np.repeat(df > 1, df)]
        self.df = df = df[df > 1]
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        doc = np.repeat(np.arange(n, dtype=np.min_scalar_type(n)), held)[order]
        tf = times[order]
        del order, fresh
        term = np.repeat(np.arange(len(df), dtype=np.uint32), df)
        self.term = term[np.argsort(doc, kind="stable")]
        self.row = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
        # the postings of the terms with a row of the table stand only there
        wide = df > DENSE
        self.dense = np.where(wide, np.cumsum(wide) - 1, -1)
        self.table = np.zeros((int(wide.sum()), n), np.float32)
        self.start = np.cumsum(np.where(wide, 0, df)) - np.where(wide, 0, df)
        rare = ~wide[term]
        self.doc, self.impact = doc[rare], np.empty(int(rare.sum()))
        done = 0
        for a in range(0, len(doc), BLOCK):
            t, d, f, r = (x[a : a + BLOCK] for x in (term, doc, tf, rare))
            f = f.astype(np.float64)
            impact = idf[t] * f * (K1 + 1) / (f + norm[d])
            upto = done + int(np.count_nonzero(r))
            self.impact[done:upto] = impact[r]
            self.table[self.dense[t[~r]], d[~r]] = impact[~r]
            done = upto
        self.free = np.ones(n, bool)
        self.at = 0

    def scores(self, seed: int) -> np.ndarray:
        """Every row's score over all terms of the seed."""
        own = self.term[self.row[seed] : self.row[seed + 1]]
        wide = self.dense[own]
        rare = own[wide < 0]
        at = spread(self.start[rare], self.df[rare])
        return np.bincount(self.doc[at], self.impact[at], len(self.free)) + self.table[wide[wide >= 0]].sum(axis=0)

    def neighbours(self, seed: int) -> Iterator[int]:
        """All unused rows that share a term with the seed, by descending score, then position."""
        scores = self.scores(seed)
        left = np.flatnonzero(self.free & (scores > 0))
        while len(left):
            now = np.ones(len(left), bool)
            if len(left) > FIRST:
                now = scores[left] >= np.partition(scores[left], len(left) - FIRST)[len(left) - FIRST]
            best, left = left[now], left[~now]
            yield from best[np.lexsort((best, -scores[best]))].tolist()

    def next(self) -> int | None:
        while self.at < len(self.free) and not self.free[self.at]:
            self.at += 1
        return self.at if self.at < len(self.free) else None


def fill(shard: Shard, lengths: list[int], room: int, window: int):
    """Yield (row, start, length, new window?) until each row's tokens are dealt; ``room`` is what the open window has left."""
    ranked: Iterator[int] = iter(())
    while True:
        row = next(ranked, None)
        seed = row is None
        if seed and (row := shard.next()) is None:
            return
        shard.free[row] = False
        done = 0
        while done < lengths[row]:
            fresh = room == 0
            room = room or window
            take = min(room, lengths[row] - done)
            yield row, done, take, fresh
            done, room, seed = done + take, room - take, seed or fresh
        if not room:
            ranked = iter(())
        elif seed:
            ranked = shard.neighbours(row)


def _narrow(ids: np.ndarray) -> bytes:
    return (ids.astype("<u2") if len(ids) and ids.max() < 65536 else ids).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if len(raw) == 4 * n else "<u2").astype("<u4")


def _terms(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 32-bit terms of each of ``n`` rows, how often each occurs, and the first one of each row."""
    keys = np.sort((row.astype(np.uint64) << np.uint64(32)) | (words >> np.uint64(32)))
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    times = np.diff(np.append(at, len(keys))).astype("<u4")
    return (keys[at] & np.uint64(0xFFFFFFFF)).astype("<u4"), times, np.searchsorted(keys[at] >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))


def shards(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``SHARD`` rows and, but for one row, ``POSTINGS`` postings, 4 bytes each in column ``at``; none is kept here."""
    held, count, postings = [], 0, 0
    for batch in batches:
        ends = np.cumsum(np.array(pc.binary_length(batch.column(at)), np.int64) // 4)
        done = 0
        while done < batch.num_rows:
            before = ends[done - 1] if done else 0
            upto = min(done + SHARD - count, int(np.searchsorted(ends, before + POSTINGS - postings, side="right")))
            upto = max(upto, done if count else done + 1)
            held.append(batch.slice(done, upto - done))
            count, postings = count + upto - done, postings + int((ends[upto - 1] if upto else 0) - before)
            done = upto
            if done < batch.num_rows or count == SHARD:
                full, held, count, postings = [pa.concat_batches(held)], [], 0, 0
                yield full.pop()
    if count:
        full, held = [pa.concat_batches(held)], []
        yield full.pop()


def pack(docs: DataFrame, *, tokenizer: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and, if asked for, ``ids`` (little-endian 32-bit).

    A document is its token ids, as the tokenizer file gives them without special tokens put around, and ``end_id``.
    Each id lies in exactly one piece, and the pieces of a sequence follow each other without gaps from offset 0.
    Files of the tokenizer are given by path and read where the tokens are made.  Terms are 32-bit hashes of words.

    NULL and empty texts are ``end_id`` alone; a NULL id and repeated rows are documents like others; a text of any
    length is cut into whole windows; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    source = docs.select(F.col(id_col), F.col(text_col))
    id_type = source.schema.fields[0].dataType.simpleString()
    names = ["id", "tail", "start", "length", "ids_crc32", "doc_tokens", "ids", "terms", "times", "sign", "place"]
    kinds = [pa.bool_(), *[pa.int64()] * 4, *[pa.binary()] * 3, *[pa.int64()] * 2]

    def cut(batches):
        bpe, place = tokens(tokenizer, ranks, pattern), TaskContext.get().partitionId() << 40
        for batch in slices(batches, 1):
            flat, at = bpe.encode_rows(batch.column(1))
            flat = np.insert(flat, at[1:], end_id).astype("<u4")
            at = at + np.arange(len(at))
            words, begin = bpe.words(flat, np.concatenate([at[:-1], at[1:] - 1]))
            own = ~np.isin(begin, at[1:] - 1, assume_unique=True)  # the end id is no word
            words, row = words[own], np.searchsorted(at, begin[own], side="right") - 1
            sign = np.full(batch.num_rows, np.iinfo(np.int64).max)
            np.minimum.at(sign, row, (words >> np.uint64(1)).astype(np.int64))
            terms, times, first = _terms(words, row, batch.num_rows)
            rows, index = [], []
            for i, (a, b, f, g, s) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), first[:-1].tolist(), first[1:].tolist(), sign.tolist(), strict=True)):
                whole = a + (b - a) // window * window
                for start in range(a, whole, window):
                    piece = flat[start : start + window].tobytes()
                    rows.append((False, start - a, window, zlib.crc32(piece), b - a, piece if with_ids else None, None, None, 0, place))
                    index.append(i)
                    place += 1
                if whole < b:
                    rest = flat[whole:b]
                    rows.append((True, whole - a, b - whole, 0, b - a, rest.tobytes() if with_ids else _narrow(rest), terms[f:g].tobytes(), times[f:g].tobytes(), s, place))
                    index.append(i)
                    place += 1
            columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), *arrays], names=names)

    pieces = materialise(source.mapInArrow(cut, f"id {id_type}, tail boolean, start long, length long, ids_crc32 long, doc_tokens long, ids binary, terms binary, times binary, sign long, place long"), "pieces")
    tails = pieces.filter("tail").select("id", "start", "length", "doc_tokens", "ids", "terms", "times", "sign", "place")
    tails = tails.repartitionByRange(partitions(docs.sparkSession), "sign", "place").sortWithinPartitions("sign", "place")
    out_names = ["id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"]
    out_kinds = [*[pa.int64()] * 4, pa.binary(), *[pa.int64()] * 2]

    def shard(table, room):
        """Row, whether a window begins, and the columns but for the sequence, for each piece of one shard; ``room`` is what the open window has left."""
        column = {c: table.column(c) for c in ("length", "start", "doc_tokens", "ids", "terms", "times")}
        lengths, starts, sizes = (column[c].to_pylist() for c in ("length", "start", "doc_tokens"))
        (raw, at), (often, _) = flat_bytes(column["terms"]), flat_bytes(column["times"])
        index = Shard(raw.view("<u4"), often.view("<u4"), np.diff(at) // 4)
        for row, start, length, fresh in fill(index, lengths, room, window):
            piece = _wide(column["ids"][row].as_buffer(), lengths[row])[start : start + length].tobytes()
            yield row, fresh, (starts[row] + start, length, zlib.crc32(piece), sizes[row], piece if with_ids else None)

    def dealt(batches):
        tokens.cache_clear()  # workers are kept, and these need no tokenizer
        trim()
        sequence, offset = (1 << 62) + (TaskContext.get().partitionId() << 40) - 1, window
        for table in shards(batches, 5):
            rows, index = [], []
            for row, fresh, piece in shard(table, window - offset):
                if fresh:
                    sequence, offset = sequence + 1, 0
                rows.append((*piece, sequence, offset))
                index.append(row)
                offset += piece[1]
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), out_kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([table.column("id").take(pa.array(index, pa.int64())), *arrays], names=out_names)
            del rows, index, arrays, table
        trim()

    packed = tails.mapInArrow(dealt, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, sequence_id long, offset long")
    whole = pieces.filter(~F.col("tail")).select("id", "start", "length", "ids_crc32", "doc_tokens", "ids", F.col("place").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = whole.union(packed).withColumnRenamed("id", id_col)
    return out if with_ids else out.drop("ids")
