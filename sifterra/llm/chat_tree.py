"""Chat formatting as a prefix tree: what conversations share at their start is written once.

A turn becomes ``### Role: text</turn>`` and a line break, with control strings in roles
and texts escaped.  The turns of all conversations form a tree; a segment is a
run of turns that the same conversations pass through.  Segments stand in
depth-first order, each with its token ids, its place in that order, the
position of its first token along its conversation, its loss mask, and the
intervals of the order that it may attend to: its ancestors'.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import tokens
from .common import global_prefix, materialise, spread_join

#: Fixed strings of the template.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"
#: The escape sign itself, and every other character that begins a control string.
ESCAPE, SPECIAL = "\\", "#<:"


def escape(text: str) -> str:
    text = text.replace(ESCAPE, ESCAPE * 2)
    for sign in SPECIAL:
        text = text.replace(sign, ESCAPE + sign)
    return text


def unescape(text: str) -> str:
    """The text that ``escape`` was given. A run of escape signs begins a pair, so pairs are found from the left."""
    pieces = text.split(ESCAPE * 2)
    for sign in SPECIAL:
        pieces = [p.replace(ESCAPE + sign, sign) for p in pieces]
    return ESCAPE.join(pieces)


def find_control(formatted: str, control: str, at: int) -> int:
    """Where ``control`` stands next without an escape sign before it, or an error."""
    while (found := formatted.find(control, at)) >= 0:
        signs = found
        while signs > at and formatted[signs - 1] == ESCAPE:
            signs -= 1
        if (found - signs) % 2 == 0:
            return found
        at = found + 1
    raise ValueError(f"no {control!r} after {at}")


def parts(role: str, text: str) -> tuple[str, str, str]:
    """The formatted turn in three parts; the middle one is the text."""
    return OPEN + escape(role) + MIDDLE, escape(text), CLOSE


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; anything else in it is an error."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"not a turn at {at}")
        role = at + len(OPEN)
        middle = find_control(formatted, MIDDLE, role)
        text = middle + len(MIDDLE)
        close = find_control(formatted, CLOSE, text)
        turns.append((unescape(formatted[role:middle]), unescape(formatted[text:close])))
        at = close + len(CLOSE)
    return turns


def build_tree(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer: str, ranks: str | None = None, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, paths) of the prefix tree.

    ``segments``: ``segment`` (its hash), ``turns`` (texts and roles are not kept apart from the tokens),
    ``token_ids``, ``loss`` (runs [from, to) of the segment's tokens under the loss mask), ``dfs_start``,
    ``position_start``, ``attends`` (intervals [from, to) of the depth-first order, outermost first; a token also
    attends to those before it in its own segment).  ``paths``: conversation and its ``segments`` in order.

    Turns go by (turn, role, text).  NULL roles and texts are empty, a NULL conversation id is one conversation of
    its own, repeated rows are repeated turns, an empty table gives two empty tables, other columns are ignored.  A
    conversation is a row of one task; however many share a beginning, that beginning is one segment.
    """
    clean = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("t"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("t").isNotNull().alias("k"), "t", "role", "text")))
    # chained hashes name the beginnings of a conversation; 128 bits of SHA-256
    talks = clean.groupBy("conv").agg(F.transform(ordered, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))

    def chained(batches):
        for batch in batches:
            out = []
            for turns in batch.column(1).to_pylist():
                state, names = b"", []
                for turn in turns:
                    state = hashlib.sha256(b"".join([state, len(turn["role"].encode()).to_bytes(8, "big"), turn["role"].encode(), turn["text"].encode()])).digest()[:16]
                    names.append(state)
                out.append(names)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.binary()))], names=["conv", "turns", "names"])

    talks = materialise(talks.mapInArrow(chained, T.StructType([*talks.schema.fields, T.StructField("names", T.ArrayType(T.BinaryType()))])), "talks")
    passing = talks.select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    # a segment begins where the number of conversations that pass changes
    steps = spread_join(talks.select("conv", F.posexplode("names").alias("at", "name")), materialise(passing.withColumn("rows", F.col("n")), "passing"), ["name"], n="rows", by="conv")
    counted = steps.groupBy("conv").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("n")).withColumnRenamed("conv", "same")
    begins = F.filter(F.sequence(F.lit(0), F.size("n") - 1), lambda i: (i == 0) | (F.element_at("n", i + 1) != F.element_at("n", F.greatest(i, F.lit(1)))))
    cut = talks.join(counted, F.col("conv").eqNullSafe(F.col("same"))).select("conv", "turns", "names", begins.alias("begins"))
    ends = F.transform("begins", lambda b, i: F.coalesce(F.try_element_at("begins", i + 2), F.size("names")))
    cut = cut.withColumn("ends", ends).withColumn("path", F.transform("ends", lambda e: F.element_at("names", e)))
    cut = materialise(cut.select("conv", "turns", "begins", "ends", "path"), "talk-paths")

    # one row for each distinct segment, whatever the number of conversations that hold it
    piece = lambda b, i: F.struct(F.slice("path", 1, i + 1).alias("path"), F.slice("turns", b + 1, F.element_at("ends", i + 1) - b).alias("turns"))
    held = cut.select(F.explode(F.transform("begins", piece)).alias("piece")).select(F.element_at("piece.path", -1).alias("segment"), "piece.path", "piece.turns")
    distinct = held.groupBy("segment").agg(F.min("path").alias("path"), F.any_value("turns").alias("turns"))

    def tokenised(batches):
        bpe = tokens(tokenizer, ranks, pattern)
        for batch in batches:
            ids, loss = [], []
            for turns in batch.column(2).to_pylist():
                own, marks, at = [], [], 0
                for turn in turns:
                    for k, part in enumerate(parts(turn["role"], turn["text"])):
                        made = bpe.encode_literal(part)
                        if k == 1 and turn["role"] == LOSS_ROLE:
                            marks += [at, at + len(made)]
                        own.append(made)
                        at += len(made)
                ids.append(np.concatenate(own).astype("<i4"))
                loss.append(marks)
            sizes = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.int32())), sizes], names=["segment", "path", "token_ids", "loss", "size"])

    made = materialise(distinct.mapInArrow(tokenised, "segment binary, path array<binary>, token_ids array<int>, loss array<int>, size long"), "segments")
    # a path sorts after its beginnings and before whatever follows them: depth-first order
    order = global_prefix(made.select("segment", "path", "size"), [F.col("path")], "size", "dfs")
    places = materialise(order.select("segment", "path", "size", F.col("__before").alias("dfs_start")), "dfs-places")
    above = places.select("segment", F.posexplode("path").alias("depth", "ancestor")).filter(F.col("segment") != F.col("ancestor"))
    below = above.groupBy("ancestor").agg(F.count("*").alias("below"))
    known = materialise(places.select(F.col("segment").alias("ancestor"), "dfs_start", "size").join(below, "ancestor"), "dfs-ancestors")
    spans = spread_join(above, known, ["ancestor"], n="below", by="segment").groupBy("segment").agg(
        F.sum("size").alias("position_start"), F.transform(F.array_sort(F.collect_list(F.struct("depth", "dfs_start", "size"))), lambda x: F.struct(x["dfs_start"].alias("from"), (x["dfs_start"] + x["size"]).alias("to"))).alias("attends")
    )
    segments = made.select("segment", "token_ids", "loss").join(places.select("segment", "dfs_start"), "segment").join(spans, "segment", "left")
    none = F.array().cast("array<struct<from: bigint, to: bigint>>")
    segments = segments.withColumns({"position_start": F.coalesce("position_start", F.lit(0).cast("long")), "attends": F.coalesce("attends", none)})
    return segments, cut.select(F.col("conv").alias(conv_col), F.col("path").alias("segments"))


@lru_cache(maxsize=1)
def decoder(tokenizer: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


def read_back(segments: DataFrame, paths: DataFrame, *, tokenizer: str, conv_col: str = "conv_id") -> DataFrame:
    """Conversations decoded from the segments alone: ``formatted`` text, ``turns`` as parsed, ``loss_text`` under the mask."""
    steps = paths.select(F.col(conv_col).alias("conv"), F.posexplode("segments").alias("depth", "segment"))
    used = steps.groupBy("segment").agg(F.count("*").alias("rows"))
    held = materialise(segments.select("segment", "token_ids", "loss").join(used, "segment"), "segments-read")
    gathered = spread_join(steps, held, ["segment"], n="rows", by="conv").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", "token_ids", "loss"))).alias("pieces"))
    schema = T.StructType([T.StructField("conv", gathered.schema["conv"].dataType), *T._parse_datatype_string("formatted string, turns array<struct<role: string, text: string>>, loss_text string").fields])

    def decoded(batches):
        slow = decoder(tokenizer)
        for batch in batches:
            texts, turns, losses = [], [], []
            for pieces in batch.column(1).to_pylist():
                text, loss = [], []
                for piece in pieces:
                    ids = piece["token_ids"]
                    text.append(slow.decode(ids, skip_special_tokens=False))
                    for a, b in zip(piece["loss"][::2], piece["loss"][1::2], strict=True):
                        loss.append(unescape(slow.decode(ids[a:b], skip_special_tokens=False)))
                texts.append("".join(text))
                turns.append([{"role": r, "text": t} for r, t in parse(texts[-1])])
                losses.append("".join(loss))
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(turns, kind), pa.array(losses, pa.string())], names=["conv", "formatted", "turns", "loss_text"])

    return gathered.mapInArrow(decoded, schema).withColumnRenamed("conv", conv_col)


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
