"""The corpus pipeline: quality rules, quality classifier, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
it kept and returns a DataFrame, which is written as Parquet and read again as
the next one's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifterra.llm import jaccard_join, line_rules, mixing, packing, quality_fm
from sifterra.llm.common import fold, materialise, table
from sifterra.llm.queries import public_tokenizer

#: Documents below this score go.
LEAST_QUALITY = 0.3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their host's frequent lines, so their lengths are taken anew."""
    kept = line_rules.keep_good(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on this stage's own documents where they are labelled, outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality_fm.fit_quality(docs, labels, lambda doc_id: fold(doc_id, 5) != 0)
    return quality_fm.keep_scored(docs, model, LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """NULL and empty texts have no shingles and stay; of equal rows one stays; columns may have any names."""
    return jaccard_join.keep_one(docs, width=5, threshold=(80, 100))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """NULL texts have size 0, a NULL source is a source of its own; no rows give none."""
    return mixing.emit(mixing.mix(docs))


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, NULL texts as their end id alone; no rows give none."""
    return packing.pack(docs, **public_tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("retrieval_packing", retrieval_packing),
]

#: The classifier and the packing have no SQL; tests/llm holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

