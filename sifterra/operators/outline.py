"""The outline of Markdown: which lines open and close code fences, which are headings, and where each stands.

Only the few lines that look like a fence or a heading matter.  An automaton
walks them; what it does to a stretch of lines is a function of the state in
which it enters, and such functions compose.  ``outline`` follows from that for
line tables of any length: lines are dealt to ranges, each range is summed up
as a function on its own, the functions meet (one small row for each range),
and each range is walked once more from the state that reaches it.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..sources.scratch import materialise

FENCE, HEADING = re.compile(text.FENCE), re.compile(text.HEADING)
#: Native test for lines that may matter.
STRUCTURAL = f"{text.FENCE}|^#{{1,6}}[ \\t]"
#: Rows that a task hands on at once.
ROWS = 10_000


@dataclass(frozen=True)
class State:
    """``fence``: sign, length and line of the open fence, or None. ``stack``: (level, title) of the headings around, outermost first."""

    fence: tuple[str, int, int] | None = None
    ordinal: int = 0
    stack: tuple[tuple[int, str], ...] = ()


def step(state: State, pos: int, line: str) -> tuple[State, str]:
    """The state after a line and what the line was: open, close, heading or nothing ("")."""
    if mark := FENCE.match(line):
        sign, n = mark[1][0], len(mark[1])
        if state.fence is None:
            return replace(state, fence=(sign, n, pos)), "open"
        if sign == state.fence[0] and n >= state.fence[1]:
            return replace(state, fence=None), "close"
        return state, ""
    if state.fence is None and (found := HEADING.match(line)):
        level = len(found[1])
        stack = (*[x for x in state.stack if x[0] < level], (level, found[2].strip()))
        return replace(state, ordinal=state.ordinal + 1, stack=stack), "heading"
    return state, ""


def walk(state: State, lines: Iterable[tuple[int, str]]) -> Iterator[tuple[int, str, State]]:
    """(line number, event, state after) of every line with an event."""
    for pos, line in lines:
        before, (state, event) = state, step(state, pos, line)
        if event:
            yield pos, event, before if event == "close" else state


@dataclass
class Effect:
    """What a stretch does to a state: the fence after it, headings counted, levels cut off the stack and what is put there."""

    fence: tuple[str, int, int] | None
    headings: int = 0
    cut: int = 7
    top: tuple[tuple[int, str], ...] = ()

    def on(self, state: State) -> State:
        return State(self.fence, state.ordinal + self.headings, (*[x for x in state.stack if x[0] < self.cut], *self.top))


@dataclass
class Summary:
    """A stretch as a function of the state that enters it.

    Entering outside a fence it has one effect. Entering inside one, the stretch goes on from the first mark of the
    same sign and at least the same length: ``marks`` has, for each sign, the lengths that occur with the effect of what follows.
    """

    outside: Effect
    marks: dict[str, tuple[list[int], list[Effect]]] = field(default_factory=dict)

    def on(self, state: State) -> State:
        if state.fence is None:
            return self.outside.on(state)
        lengths, effects = self.marks.get(state.fence[0], ([], []))
        at = bisect_left(lengths, state.fence[1])
        return effects[at].on(state) if at < len(lengths) else state


def effect(lines: list[tuple[int, str]]) -> Effect:
    """The effect on a state outside any fence."""
    state, cut = State(), 7
    for pos, line in lines:
        state, event = step(state, pos, line)
        if event == "heading":
            cut = min(cut, state.stack[-1][0])
    return Effect(state.fence, state.ordinal, cut, state.stack)


def summarise(lines: list[tuple[int, str]]) -> Summary:
    """Only marks longer than all of their sign before can be the first to close something: few lengths remain."""
    marks: dict[str, tuple[list[int], list[Effect]]] = {}
    for i, (_, line) in enumerate(lines):
        if mark := FENCE.match(line):
            lengths, effects = marks.setdefault(mark[1][0], ([], []))
            if not lengths or len(mark[1]) > lengths[-1]:
                lengths.append(len(mark[1]))
                effects.append(effect(lines[i + 1 :]))
    return Summary(effect(lines), marks)


def outline(lines: DataFrame, key: str, *, pos: str = "pos", line: str = "line") -> DataFrame:
    """(key, ``pos``, ``event``, ``opened``, ``ordinal``, ``path``) of lines that open or close a fence or are headings.

    ``lines`` has a row for each line of any number of documents of any length, in any order; equal positions of a key are
    an error of the caller. ``opened`` is the fence's first line, ``ordinal`` counts the headings of a document up to here,
    ``path`` holds their titles. No task needs a whole document, and only lines that may matter are shuffled.
    """
    spark, kind = lines.sparkSession, lines.schema[key].dataType
    marked = lines.select(F.col(key).alias("key"), F.col(pos).cast("long").alias("pos"), F.col(line).alias("line")).filter(F.col("line").rlike(STRUCTURAL))
    ranged = marked.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "pos").sortWithinPartitions("key", "pos")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield batch.assign(part=part, at=range(done, done + len(batch)))
            done += len(batch)

    schema = T.StructType([T.StructField("key", kind), T.StructField("pos", T.LongType()), T.StructField("line", T.StringType())])
    held = materialise(ranged.mapInPandas(number, T.StructType([*schema, T.StructField("part", T.LongType()), T.StructField("at", T.LongType())])), "outline")
    whole = held.repartition("part").sortWithinPartitions("part", "at")

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, object, list[tuple[int, str]]]]:
        """(range, key, its lines there), in order."""
        now, rows = None, []
        for batch in batches:
            for part, k, p, text_ in zip(batch["part"].tolist(), batch["key"].tolist(), batch["pos"].tolist(), batch["line"].tolist(), strict=True):
                if now != (part, k):
                    if now is not None:
                        yield *now, rows
                    now, rows = (part, k), []
                rows.append((p, text_))
        if now is not None:
            yield *now, rows

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each range the function of its first key's lines, and the state after its last key where that is another."""
        found: dict[int, list] = {}
        for part, k, rows in stretches(batches):
            mine = found.setdefault(part, [])
            if not mine:
                mine[:] = [k, summarise(rows), k, None]
            else:
                mine[2:] = [k, effect(rows).on(State())]
        yield pd.DataFrame({"part": pd.Series(list(found), dtype="int64"), "ends": [pickle.dumps(x) for x in found.values()]})

    entering, last, state = {}, None, State()
    for row in sorted(whole.mapInPandas(ends, "part long, ends binary").collect(), key=lambda r: r["part"]):  # one row per range
        first, function, final, after = pickle.loads(row["ends"])
        state = state if last == first else State()
        entering[row["part"]] = state
        state, last = function.on(state) if after is None else after, final
    shared = spark.sparkContext.broadcast(entering)

    names = ["key", "pos", "event", "opened", "ordinal", "path"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        columns = dict(zip(names, zip(*rows, strict=True), strict=True))
        return pd.DataFrame(columns | {"opened": pd.array(columns["opened"], "Int64")})

    def events(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, held = None, []
        for part, k, rows in stretches(batches):
            state = shared.value[part] if part != seen else State()
            seen = part
            held += [(k, p, e, None if e == "heading" else s.fence[2], s.ordinal, [t for _, t in s.stack]) for p, e, s in walk(state, rows)]
            if len(held) >= ROWS:
                yield frame(held)
                held = []
        if held:
            yield frame(held)

    out = T.StructType([schema[0], schema[1], T.StructField("event", T.StringType()), T.StructField("opened", T.LongType()), T.StructField("ordinal", T.IntegerType()), T.StructField("path", T.ArrayType(T.StringType()))])
    return whole.mapInPandas(events, out).withColumnRenamed("key", key)
