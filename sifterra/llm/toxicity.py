"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Lexicon voters hold words or word beginnings that training rows tie to one
label; pattern voters look at a text's form, and speak for the label under which
it is more frequent.  Labels are used for nothing else: from the votes' majority on, a generative model estimates how often each voter
says what under either label, and which voters repeat each other; its posterior
labels then train a linear classifier over lexical units and votes, which
scores texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import mix
from .features import N_STRUCTURE, Rows, bounded_sample, score_texts, sigmoid, structure

#: Most training rows of either label.
SAMPLE_PER_LABEL = 4_000
#: Kinds of lexical units: whole word, then its first 4, 5 and 6 letters. A beginning of several words is one more unit.
BEGINNINGS = (0, 4, 5, 6)
SEVERAL = len(BEGINNINGS) - 1
KIND_BITS = 28
#: Groups that each kind's lexicon is dealt to, one voter each.
GROUPS = 4
#: How many of all units may pass for evidence by chance, which sets the least likelihood-ratio statistic of one.
BY_CHANCE = 0.01
#: A lexicon unit is so many times as frequent under one label.
SURE = 100.0
#: Words whose units a worker remembers.
REMEMBERED = 50_000


class Units(dict):
    """Unit numbers of a word: one of each kind, by hash."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        import zlib

        if len(self) >= REMEMBERED:
            self.clear()
        core = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„’…").lower() or word
        found = []
        for kind, length in enumerate(BEGINNINGS):
            if length == 0 or len(core) > length:
                part = core[:length] if length else core
                found.append((kind << KIND_BITS) | (zlib.crc32(part.encode("utf-8", "replace"), kind) & ((1 << KIND_BITS) - 1)))
        value = tuple(found)
        if len(word) <= 64:
            self[word] = value
        return value


@dataclass
class LabelModel:
    """P(vote | label) per voter, the voters' correlation inside a label as far as it counts, and the prior."""

    prior: float
    given: np.ndarray  # voter, label, vote + 1
    correlation: np.ndarray

    def weights(self, votes: np.ndarray) -> np.ndarray:
        """Of each vote, by row: a voter shares its weight with those that speak along and repeat it."""
        return 1.0 / (1.0 + (votes != 0) @ np.abs(self.correlation))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(self.given)
        said = (logs[:, 1] - logs[:, 0]) * [1, 0, 1]  # who abstains says nothing
        gap = (self.weights(votes) * said[np.arange(votes.shape[1])[None, :], votes + 1]).sum(axis=1)
        return sigmoid(gap + np.log(self.prior / (1 - self.prior)))


def majority(votes: np.ndarray) -> np.ndarray:
    """What most of those who vote say, softly; a row on which nobody votes is taken for clean, as most rows are. No label is looked at."""
    return np.where(votes.sum(axis=1) > 0, 0.9, 0.1)


def fit_label_model(votes: np.ndarray, start: np.ndarray, *, rounds: int = 12, linked: float = 0.15) -> LabelModel:
    """Expectation maximisation from the soft labels ``start``.

    Each round estimates how voters vote under either label and their correlation beyond what the label explains
    (over ``linked``), and from both the next soft labels.
    """
    n, m = votes.shape
    q = start.astype(float)
    model = None
    for _ in range(rounds):
        given = np.empty((m, 2, 3))
        for label, share in enumerate((1 - q, q)):
            for vote in (-1, 0, 1):
                given[:, label, vote + 1] = share @ (votes == vote) + 0.5
        given /= given.sum(axis=2, keepdims=True)
        joint = np.zeros((m, m))
        for label, share in enumerate((1 - q, q)):
            mean = given[:, label, 2] - given[:, label, 0]
            apart = votes - mean
            cov = (apart * share[:, None]).T @ apart / max(1e-9, share.sum())
            scale = np.sqrt(np.clip(np.diag(cov), 1e-6, None))
            joint += cov / scale[:, None] / scale[None, :] / 2
        np.fill_diagonal(joint, 0)
        model = LabelModel(float(np.clip(q.mean(), 0.01, 0.99)), given, np.where(np.abs(joint) > linked, joint, 0))
        after = model.posterior(votes)
        if np.abs(after - q).max() < 1e-4:
            break
        q = after
    return model


@dataclass
class ToxicityModel:
    """Sorted unit numbers with their weights and lexicon voters, pattern limits, and the bias."""

    units: np.ndarray
    weights: np.ndarray
    voter: np.ndarray  # of each unit, -1 for none
    side: np.ndarray  # what each voter says
    limits: np.ndarray  # of pattern voters
    pattern_side: np.ndarray
    vote_weights: np.ndarray
    bias: float
    label_model: LabelModel

    def votes(self, at: np.ndarray, form: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.side) + len(self.limits) + 1, np.int64)
        said = self.voter[at]
        said = np.unique(said[said >= 0])
        out[said] = self.side[said]
        out[len(self.side) : -1] = np.where(form > self.limits, self.pattern_side, 0)
        out[-1] = 0 if (out[: len(self.side)] > 0).any() else -1  # speaks when no toxic lexicon does
        return out

    def raw(self, numbers: np.ndarray, form: np.ndarray) -> float:
        at = np.searchsorted(self.units, numbers)
        at[at == len(self.units)] = 0
        at = at[self.units[at] == numbers] if len(self.units) else at[:0]
        return float(self.bias + self.weights[at].sum() + self.vote_weights @ self.votes(at, form))


def parse(text: bytes, known: Units) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct units and its form."""
    words = text.decode("utf-8", "replace").split()
    found = np.fromiter(chain.from_iterable(map(known.__getitem__, set(words))), np.int64)
    units, times = np.unique(found, return_counts=True)
    often = units[(times > 1) & (units >= 1 << KIND_BITS)] + (SEVERAL << KIND_BITS)
    return np.concatenate([units, often]), np.array(structure(text, text.split()))


def copy_weights(flat: np.ndarray, row: np.ndarray, n: int, *, hashes: int = 32) -> np.ndarray:
    """One over the size of each row's group of near copies.

    Copies of one text would make its chance words look like evidence. Rows are compared by least hashes of their units
    that at most half of the rows hold: a row belongs to the first row with which it shares one of them, if they share
    six in ten.
    """
    often = np.bincount(flat)[flat]
    rare = often <= max(3, n // 2)
    signs = np.tile(np.arange(n, dtype=np.uint64)[:, None], (1, hashes))  # without such units a row is nobody's copy
    held = np.unique(row[rare])
    for i in range(hashes):
        least = np.full(n, np.iinfo(np.uint64).max)
        np.minimum.at(least, row[rare], mix(flat[rare].astype(np.uint64), 40 + i))
        signs[held, i] = least[held]
    group = np.arange(n)
    for i in [*range(hashes), *range(hashes)]:
        _, first, where = np.unique(signs[:, i], return_index=True, return_inverse=True)
        leader = first[where]
        alike = (signs == signs[leader]).mean(axis=1) >= 0.6
        group = np.minimum(group, np.where(alike, group[leader], group))
    _, where, size = np.unique(group, return_inverse=True, return_counts=True)
    return 1.0 / size[where]


def fit(numbers: list[np.ndarray], forms: np.ndarray, labels: np.ndarray, *, steps: int = 300) -> ToxicityModel:
    """Lexicons, voters, label model and classifier from a bounded set of training rows."""
    flat, row = np.concatenate(numbers), np.repeat(np.arange(len(numbers)), [len(x) for x in numbers])
    present, where = np.unique(flat, return_inverse=True)
    counted = copy_weights(where, row, len(numbers))
    positive, negative = max(1.0, counted[labels == 1].sum()), max(1.0, counted[labels == 0].sum())
    hit = np.bincount(where, counted[row] * (labels[row] == 1))
    miss = np.bincount(where, counted[row] * (labels[row] == 0))
    # the rarer side counts as what it is less one standard deviation, so that few rows don't hide a sure unit
    least = lambda n: np.maximum(0.0, n - np.sqrt(n))
    toxic_gap = np.log((hit + 0.5) / positive * negative / (least(miss) + 0.5))
    clean_gap = np.log((miss + 0.5) / negative * positive / (least(hit) + 0.5))
    # the likelihood ratio against "no tie", whose tail falls as exp(-x / 2): the more units are tried, the more is asked of one
    share = positive / (positive + negative)
    seen = np.maximum(hit + miss, 1e-9)
    strength = 2 * (hit * np.log(np.maximum(hit, 1e-9) / (seen * share)) + miss * np.log(np.maximum(miss, 1e-9) / (seen * (1 - share))))
    picked = np.flatnonzero(strength > 2 * np.log(len(present) / BY_CHANCE))
    units = present[picked]
    # a lexicon takes units that are nearly always of one label, at equal class sizes
    sure = np.where(toxic_gap[picked] > np.log(SURE), 1, np.where(clean_gap[picked] > np.log(SURE), -1, 0))
    kind, group = units >> KIND_BITS, units % GROUPS
    voter = np.where(sure != 0, (kind * GROUPS + group) * 2 + (sure > 0), -1)
    n_lexicons = (len(BEGINNINGS) + SEVERAL) * GROUPS * 2
    side = np.where(np.arange(n_lexicons) % 2 == 1, 1, -1)
    limits = np.quantile(forms, 0.9, axis=0)
    over = forms > limits
    toxic_share, clean_share = (counted * (labels == 1)) @ over / positive, (counted * (labels == 0)) @ over / negative
    model = ToxicityModel(units, np.zeros(len(units)), voter, side, limits, np.where(toxic_share > clean_share, 1, -1), np.zeros(n_lexicons + forms.shape[1] + 1), 0.0, None)
    at = np.searchsorted(units, flat)
    at[at == len(units)] = 0
    held = units[at] == flat if len(units) else np.zeros(len(flat), bool)
    at, row = at[held], row[held]
    starts = np.searchsorted(row, np.arange(len(numbers) + 1))
    votes = np.array([model.votes(at[a:b], form) for a, b, form in zip(starts[:-1], starts[1:], forms, strict=True)])
    model.label_model = fit_label_model(votes, majority(votes[:, :n_lexicons]))
    soft = model.label_model.posterior(votes)
    # logistic regression on the posterior labels, classes at equal weight
    rows = Rows([], [])
    rows.size, rows.number, rows.row, rows.value = np.diff(starts), at, row, np.ones(len(at))
    yes = soft > 0.5
    weight = counted * np.where(yes, 0.5 / max(1.0, counted[yes].sum()), 0.5 / max(1.0, counted[~yes].sum()))
    n, k = len(units), votes.shape[1]
    theta, m, v = np.zeros(n + k + 1), np.zeros(n + k + 1), np.zeros(n + k + 1)
    for step in range(1, steps + 1):
        error = weight * (sigmoid(rows.dot(theta[:n]) + votes @ theta[n : n + k] + theta[-1]) - soft)
        g = np.concatenate([rows.dot_t(error, n), error @ votes, [error.sum()]]) + 1e-5 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    model.weights, model.vote_weights, model.bias = theta[:n], theta[n : n + k], float(theta[-1])
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, training: Callable[[Column], Column], *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = SAMPLE_PER_LABEL) -> ToxicityModel | None:
    """Fit on at most ``per_label`` training rows of either label; None if one label is missing. Only texts are inputs."""
    marked = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).filter(F.col("__id").isNotNull() & F.col("__y").isin(0, 1)).filter(training(F.col("__id")))
    marked = marked.groupBy("__id").agg(F.max("__y").alias("__y"))
    marked = bounded_sample(marked.filter("__y = 1"), "__id", per_label).union(bounded_sample(marked.filter("__y = 0"), "__id", per_label))
    known = Units()

    def features(raw: list[bytes], extras: list[list]):
        parsed = [parse(text, known) for text in raw]
        return [[p[0].astype(np.int32).tobytes() for p in parsed], [p[1].tobytes() for p in parsed], np.array(extras[0], np.int32)]

    # two numbers for each of at most 2 * per_label rows
    joined = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(marked), "__id")
    got = score_texts(joined, "__id", "__text", ["__y"], "units binary, form binary, y int", features)
    # one row for each sampled id; where ids repeat, a sample by hash again
    got = got.orderBy(F.xxhash64("__id", "units"), "__id").limit(4 * per_label).collect()
    y = np.array([r["y"] for r in got])
    if len(set(y.tolist())) < 2:
        return None
    return fit([np.frombuffer(r["units"], np.int32).astype(np.int64) for r in got], np.array([np.frombuffer(r["form"]) for r in got]).reshape(-1, N_STRUCTURE), y)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``score``) for every row; without a model each score is 0.5.

    NULL text counts as empty and still gets a score; repeated rows get equal scores; very long texts are read
    whole; an empty table gives no rows; other columns are ignored.
    """
    shared, known = docs.sparkSession.sparkContext.broadcast(model), Units()

    def score(raw: list[bytes], extras: list[list]):
        fitted = shared.value
        if fitted is None:
            return [np.full(len(raw), 0.5)]
        return [sigmoid(np.array([fitted.raw(*parse(text, known)) for text in raw], float))]

    return score_texts(docs, id_col, text_col, [], "score double", score)
