"""Language identification by nearest centroid over TF-IDF vectors of hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, discard, materialise
from .features import score_texts
from .kernels import mix

#: Most training documents of a language; they are the least hashes of each of ``SAMPLE_CLASSES`` hash classes.
SAMPLE_PER_LANGUAGE = 1_500
SAMPLE_CLASSES = 64
#: Hashed n-grams of one, two and three letters.
BINS = 1 << 12
SIZES = (1, 2, 3)
CENTROIDS = 3
#: A smaller cluster of a language stays only if no other language's main centroid is nearer to it than its own.
MINOR_SHARE = 0.1
#: Characters of a text handled at once.
PIECE = 1 << 18
#: Word characters but digits; a few of them, such as fractions and Roman numerals, are no letters.
MAYBE_LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in MAYBE_LETTER.finditer(text))


def counts(text: str) -> np.ndarray:
    """How often each bin's n-grams occur in the whole text, lower-cased, with runs of non-letters and both ends as one gap."""
    total = np.zeros(BINS)
    lowered = text.lower()
    held = np.full(1, 32, np.uint64)  # what is already counted, as far as later n-grams reach back
    for start in range(0, len(lowered) + 1, PIECE):
        piece = lowered[start : start + PIECE] + (" " if start + PIECE > len(lowered) else "")
        codes = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        gap = (codes < 65) | ((codes > 90) & (codes < 97)) | ((codes > 122) & (codes < 192))
        codes[gap] = 32
        after_gap = np.concatenate([held[-1:] == 32, gap[:-1]])
        codes = np.concatenate([held, codes[~(gap & after_gap)]])
        key = codes
        for n in range(1, SIZES[-1] + 1):
            if n > 1:
                key = (key << np.uint64(21))[: max(0, len(codes) - n + 1)] | codes[n - 1 :]
            fresh = key[max(0, len(held) - n + 1) :]  # those that end in this piece
            if n in SIZES and len(fresh):
                total += np.bincount((mix(fresh, 60 + n) % np.uint64(BINS)).astype(np.int64), minlength=BINS)
        held = codes[1 - SIZES[-1] :]
    return total


@dataclass
class Centroids:
    """Unit vectors, their languages, the weights of bins, and each centroid's least usual cosine."""

    vectors: np.ndarray
    languages: list[str]
    idf: np.ndarray
    reach: np.ndarray

    def vector(self, total: np.ndarray) -> np.ndarray:
        return weighed(total, self.idf)


def weighed(total: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors of counts."""
    v = np.log1p(total) * idf
    return v / np.maximum(1e-12, np.linalg.norm(v, axis=-1, keepdims=True))


def spherical_clusters(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by spherical k-means; seeds are rows far from those before."""
    seeds = [rows.sum(axis=0) / max(1e-12, np.linalg.norm(rows.sum(axis=0)))]
    near = rows @ seeds[0]
    while len(seeds) < min(k, len(rows)):
        seeds.append(rows[int(np.argmin(near))])
        near = np.maximum(near, rows @ seeds[-1])
    centres = np.array(seeds)
    for _ in range(rounds):
        owner = np.argmax(rows @ centres.T, axis=1)
        moved = centres.copy()
        for c in range(len(centres)):
            if (owner == c).any():
                moved[c] = rows[owner == c].sum(axis=0)
        moved /= np.maximum(1e-12, np.linalg.norm(moved, axis=1, keepdims=True))
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def language_centroids(totals: list[bytes], idf: np.ndarray, k: int) -> list[tuple[bytes, float, float]]:
    """(vector, share, reach) of each cluster of one language's documents."""
    rows = weighed(np.array([np.frombuffer(x, np.uint32) for x in totals]).astype(np.float32), idf.astype(np.float32))
    centres = spherical_clusters(rows, k)
    cosines = rows @ centres.T
    owner, best = np.argmax(cosines, axis=1), np.max(cosines, axis=1)
    return [(centres[c].astype(np.float32).tobytes(), float((owner == c).mean()), float(np.quantile(best[owner == c], 0.01))) for c in range(len(centres)) if (owner == c).any()]


def settled(found: list[tuple[str, np.ndarray, float, float]], idf: np.ndarray) -> Centroids:
    """The model of all languages' clusters (language, vector, share, reach).

    A few odd or mislabelled documents make no centroid: a minor cluster goes if another language's main
    centroid is nearer to it than its own language's.
    """
    found = sorted(found, key=lambda x: (x[0], -x[2], x[1].tobytes()))
    names, vectors = [x[0] for x in found], np.array([x[1] for x in found], np.float64)
    top = {}
    for i, name in enumerate(names):
        top.setdefault(name, i)
    main = np.array([x[2] >= MINOR_SHARE for x in found]) | np.isin(np.arange(len(found)), list(top.values()))
    own = np.array([[a == b for b in names] for a in names])
    cosines = vectors @ vectors.T
    kept = [i for i in range(len(found)) if main[i] or not (cosines[i, main & ~own[i]] > cosines[i, main & own[i]].max()).any()]
    return Centroids(vectors[kept], [names[i] for i in kept], idf, np.array([found[i][3] for i in kept]))


def sampled(known: DataFrame, per_language: int) -> DataFrame:
    """(``__id``, ``__name``) of at most ``per_language`` rows of each language, by hashes of the id alone.

    A language's rows are dealt to hash classes, so no task ranks a whole language, and tasks drop what can't be
    among the least before they shuffle.
    """
    h = F.xxhash64("__id")
    ranked = known.select("__id", F.col("__lang").alias("__name"), h.alias("__h"), F.pmod(F.xxhash64(h), F.lit(SAMPLE_CLASSES)).alias("__class"))
    order = W.partitionBy("__name", "__class").orderBy("__h", "__id")
    least = ranked.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= max(1, per_language // SAMPLE_CLASSES))
    return least.select("__id", "__name").distinct()


def fit_languages(docs: DataFrame, training: Callable[[Column], Column], *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, k: int = CENTROIDS) -> Centroids | None:
    """Fit on at most ``per_language`` training documents of every language; None without any.

    Count vectors stay with the executors, where each language is clustered on its own.  The driver gets one number
    for each bin, and ``k`` vectors of 16 KB for each language: the model itself.
    """
    known = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).cast("string").alias("__lang"))
    known = known.filter(F.col("__id").isNotNull() & F.col("__lang").isNotNull()).filter(training(F.col("__id")))
    picked = materialise(sampled(known, per_language), "language-sample")
    joined = known.join(F.broadcast(picked) if picked.count() <= BROADCAST_IDS else picked, "__id").filter((F.col("__lang") == F.col("__name")) & F.col("__text").isNotNull())

    def features(raw: list[bytes], extras: list[list]):
        totals = [counts(x.decode("utf-8", "replace")).astype(np.uint32).tobytes() for x in raw]
        return [totals, extras[0]]

    vectors = materialise(score_texts(joined, "__id", "__text", ["__lang"], "totals binary, lang string", features), "language-vectors")

    def held(batches):
        n, df = 0, np.zeros(BINS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                df += np.frombuffer(x.as_py(), np.uint32) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BINS)), pa.array(np.concatenate([[n], df]))], names=["bin", "n"])

    sums = vectors.select("totals").mapInArrow(held, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect()  # BINS + 1 rows
    if not sums or not sums[0]["n"]:
        return None
    idf = np.log((1 + sums[0]["n"]) / (1 + np.array([r["n"] for r in sums[1:]]))) + 1e-3

    def clustered(rows: pd.DataFrame) -> pd.DataFrame:
        made = language_centroids(rows["totals"].tolist(), idf, k)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "vector": [m[0] for m in made], "share": [m[1] for m in made], "reach": [m[2] for m in made]})

    # at most ``per_language`` rows a group, of a fixed size; their order settles the seeds
    found = vectors.select("lang", "totals", "__id").groupBy("lang").applyInPandas(lambda rows: clustered(rows.sort_values(["__id", "totals"])), "lang string, vector binary, share double, reach double").collect()
    discard(vectors)
    discard(picked)
    return settled([(r["lang"], np.frombuffer(r["vector"], np.float32), r["share"], r["reach"]) for r in found], idf)


def identify(docs: DataFrame, model: Centroids | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``lang_pred``, ``score``, ``rejected``) for every row.

    The prediction is the language of the nearest centroid and the score its cosine.  A text farther from that
    centroid than nearly all of the centroid's own documents is marked ``rejected``; the nearest language is kept.

    NULL, empty and letterless texts are ``und`` with score 0 and rejected, and so is every row without a model;
    repeated rows get equal results; very long texts are read whole; an empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(raw: list[bytes], extras: list[list]):
        fitted, names, scores, rejected = shared.value, [], [], []
        for x in raw:
            text = x.decode("utf-8", "replace")
            if fitted is None or not has_letter(text):
                names.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                continue
            cosines = fitted.vectors @ fitted.vector(counts(text))
            best = int(np.argmax(cosines))
            names.append(fitted.languages[best])
            scores.append(float(np.clip(cosines[best], 0.0, 1.0)))
            rejected.append(bool(cosines[best] < fitted.reach[best]))
        return [names, np.array(scores, float), np.array(rejected, bool)]

    return score_texts(docs, id_col, text_col, [], "lang_pred string, score double, rejected boolean", score)
