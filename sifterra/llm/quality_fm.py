"""Text quality by a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import positional
from .features import N_STRUCTURE, Hashed, Rows, bounded_sample, score_texts, sigmoid, structure
from .kernels import binaries, slices

#: Most labelled rows that the model is fitted on.
SAMPLE = 5_000
WORD_BINS = 1 << 15
LENGTH_BINS = 24
RANK = 8
SHORTEST_SUFFIX = 3


@dataclass
class FactorisationMachine:
    """bias + w.x + sum over pairs <v_i, v_j> x_i x_j, by (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, rows: Rows) -> np.ndarray:
        out = self.bias + rows.dot(self.linear)
        for f in range(self.factors.shape[1]):
            vx = rows.value * self.factors[rows.number, f]
            total = np.bincount(rows.row, vx, len(rows.size))
            out += 0.5 * (total**2 - np.bincount(rows.row, vx**2, len(rows.size)))
        return out


def _row(text: bytes, length: int | None, known: Hashed) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text: distinct words and word ends (joint unit length), structure, length class."""
    words = text.split()
    distinct = set(words)
    codes = {known[w] for w in distinct}
    codes |= {known[b"$" + w[-SHORTEST_SUFFIX:]] for w in distinct}
    numbers = np.fromiter(codes, np.int64, len(codes))
    values = np.full(len(numbers), 1.0 / np.sqrt(max(1, len(numbers))))
    size = LENGTH_BINS - 1 if length is None or length < 0 else min(LENGTH_BINS - 2, int(length).bit_length())
    numbers = np.concatenate([numbers, WORD_BINS + np.arange(N_STRUCTURE), [WORD_BINS + N_STRUCTURE + size]])
    return numbers, np.concatenate([values, structure(text, words), [0.3]])


N_FEATURES = WORD_BINS + N_STRUCTURE + LENGTH_BINS


def fit_machine(rows: Rows, labels: np.ndarray, *, epochs: int = 40, rank: int = RANK, l2: float = 1e-5, seed: int = 7) -> FactorisationMachine:
    """Full-batch Adam on the logistic loss, classes weighted to equal halves."""
    rng = np.random.default_rng(seed)
    used, number = np.unique(rows.number, return_inverse=True)  # only features that occur are fitted
    local = Rows([], [])
    local.size, local.row, local.value, local.number = rows.size, rows.row, rows.value, number
    n = len(used)
    theta = np.concatenate([[0.0], np.zeros(n), rng.normal(0, 0.02, n * rank)])
    positive = max(1, int(labels.sum()))
    weight = np.where(labels == 1, 0.5 / positive, 0.5 / max(1, len(labels) - positive))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, epochs + 1):
        bias, linear, factors = theta[0], theta[1 : n + 1], theta[n + 1 :].reshape(rank, n)
        raw, sums = bias + local.dot(linear), []
        for f in range(rank):
            vx = local.value * factors[f, number]
            sums.append(np.bincount(local.row, vx, len(labels)))
            raw += 0.5 * (sums[-1] ** 2 - np.bincount(local.row, vx**2, len(labels)))
        error = weight * (sigmoid(raw) - labels)
        grad = [[error.sum()], local.dot_t(error, n) + l2 * linear]
        squares = np.bincount(number, error[local.row] * local.value**2, n)
        grad += [local.dot_t(error * sums[f], n) - factors[f] * squares + l2 * factors[f] for f in range(rank)]
        g = np.concatenate(grad)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    linear, factors = np.zeros(N_FEATURES), np.zeros((N_FEATURES, rank))
    linear[used], factors[used] = theta[1 : n + 1], theta[n + 1 :].reshape(rank, n).T
    return FactorisationMachine(float(theta[0]), linear, factors)


def fit_quality(docs: DataFrame, labels: DataFrame, training: Callable[[Column], Column], *, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", label_col: str = "quality", sample: int = SAMPLE) -> FactorisationMachine | None:
    """Fit on at most ``sample`` labelled rows for which ``training`` holds; None without both labels.

    Only texts and their length are inputs.  The rows are a fixed hash sample and their number bounds
    what reaches the driver: hashed features, never texts.
    """
    marked = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).filter(F.col("__id").isNotNull() & F.col("__y").isin(0, 1)).filter(training(F.col("__id")))
    marked = bounded_sample(marked.groupBy("__id").agg(F.max("__y").alias("__y")), "__id", sample)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(length_col).cast("long").alias("__n"))
    # at most ``sample`` rows of two numbers
    joined = texts.join(F.broadcast(marked), "__id")

    known = Hashed(WORD_BINS)

    def features(raw: list[bytes], extras: list[list]):
        rows = [_row(text, n, known) for text, n in zip(raw, extras[0], strict=True)]
        return [[r[0].astype(np.int32).tobytes() for r in rows], [r[1].astype(np.float32).tobytes() for r in rows], np.array(extras[1], np.int32)]

    got = score_texts(joined, "__id", "__text", ["__n", "__y"], "numbers binary, amounts binary, y int", features)
    # one row for each sampled id; where ids repeat, a sample by hash again
    got = got.orderBy(F.xxhash64("__id", "numbers", "amounts"), "__id").limit(2 * sample).collect()
    y = np.array([r["y"] for r in got])
    if len(set(y.tolist())) < 2:
        return None
    rows = Rows([np.frombuffer(r["numbers"], np.int32) for r in got], [np.frombuffer(r["amounts"], np.float32).astype(np.float64) for r in got])
    return fit_machine(rows, y)


def score_quality(docs: DataFrame, model: FactorisationMachine | None, *, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """(id, ``score``) for every row; without a model each score is 0.5.

    NULL text counts as empty and still gets a score, from structure alone; a NULL length is a class of its own;
    repeated rows get equal scores; very long texts are read whole; an empty table gives no rows.
    """
    shared, known = docs.sparkSession.sparkContext.broadcast(model), Hashed(WORD_BINS)

    def score(raw: list[bytes], extras: list[list]):
        machine = shared.value
        if machine is None or not raw:
            return [np.full(len(raw), 0.5)]
        rows = [_row(text, n, known) for text, n in zip(raw, extras[0], strict=True)]
        return [sigmoid(machine.raw(Rows([r[0] for r in rows], [r[1] for r in rows])))]

    return score_texts(docs.select(id_col, text_col, F.col(length_col).cast("long").alias("__length")), id_col, text_col, ["__length"], "score double", score)


def keep_scored(docs: DataFrame, model: FactorisationMachine | None, least: float, *, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, in one narrow pass; columns stay as they are, whatever their names.

    NULL texts are scored as empty ones; without a model, and of an empty table, every row stays.
    """
    shared, known = docs.sparkSession.sparkContext.broadcast(model), Hashed(WORD_BINS)
    at, length = docs.columns.index(text_col), docs.columns.index(length_col)

    def scan(batches):
        machine = shared.value
        for batch in slices(batches, at):
            if machine is not None and batch.num_rows:
                rows = [_row(text or b"", n, known) for text, n in zip(binaries(batch.column(at)), batch.column(length).to_pylist(), strict=True)]
                scores = sigmoid(machine.raw(Rows([r[0] for r in rows], [r[1] for r in rows])))
                batch = batch.filter(pa.array(scores >= least))
            yield batch

    plain, _ = positional(docs)
    return plain.mapInArrow(scan, plain.schema).toDF(*docs.columns)
