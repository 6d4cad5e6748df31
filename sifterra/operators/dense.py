"""Dense retrieval: embedding models, a checked index of unit vectors, exact cosine top-k."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import bound_batches, materialise
from .lexical import RANK_DECIMALS, check_top_k, named

SCHEMA_VERSION = 2
#: Queries that are multiplied at once, and bytes of queries (as doubles) that a task holds.
QUERY_BLOCK, QUERY_BYTES = 512, 64 << 20
#: Bytes of vectors (as doubles) of a cell of the grid.
VECTOR_BYTES = 64 << 20
#: Vectors that are multiplied at once.
VECTOR_ROWS = 8_192


@dataclass(frozen=True)
class EmbeddingModelConfig:
    provider: str
    model_name: str
    dimension: int
    query_prefix: str = ""
    document_prefix: str = ""

    def __post_init__(self) -> None:
        for wrong, message in (
            (not self.provider.strip(), "Embedding provider must not be empty"),
            (not self.model_name.strip(), "Embedding model name must not be empty"),
            (self.dimension < 1, "Embedding dimension must be at least 1"),
        ):
            if wrong:
                raise ValueError(message)


@runtime_checkable
class EmbeddingModel(Protocol):
    """What an embedding model offers; ``embed_documents`` and ``embed_query`` add their prefixes."""

    config: EmbeddingModelConfig

    def embed_documents(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray: ...


class HashingEmbedder:
    """A deterministic model without weights: signed hashes of tokens. For tests and machines without a model."""

    def __init__(self, config: EmbeddingModelConfig):
        self.config = config

    def _embed(self, text: str) -> np.ndarray:
        out = np.zeros(self.config.dimension, np.float32)
        for token in text.lower().split():
            digest = hashlib.md5(token.encode()).digest()
            out[int.from_bytes(digest[:4], "big") % len(out)] += 1.0 if digest[4] & 1 else -1.0
        if not out.any():
            out[0] = 1.0
        return out

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        return np.array([self._embed(self.config.document_prefix + t) for t in texts], np.float32).reshape(-1, self.config.dimension)

    def embed_query(self, text: str) -> np.ndarray:
        return self._embed(self.config.query_prefix + text)


class SentenceTransformerModel:
    """The optional sentence-transformers library behind the same protocol; imported when used."""

    def __init__(self, model_name: str, *, batch_size: int = 32, device: str = "cpu", query_prefix: str = "query: ", document_prefix: str = "passage: "):
        if not model_name.strip():
            raise ValueError("Embedding model name must not be empty")
        if batch_size < 1:
            raise ValueError(f"batch_size must be at least 1, got {batch_size}")
        from sentence_transformers import SentenceTransformer

        self.model, self.batch_size = SentenceTransformer(model_name, device=device), batch_size
        dimension = self.model.get_sentence_embedding_dimension()
        if dimension is None:
            raise ValueError("Embedding model dimension is unknown")
        self.config = EmbeddingModelConfig("sentence-transformers", model_name, dimension, query_prefix, document_prefix)

    def _encode(self, texts: list[str]) -> np.ndarray:
        return self.model.encode(texts, batch_size=self.batch_size, convert_to_numpy=True, normalize_embeddings=False, show_progress_bar=False)

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        return self._encode([self.config.document_prefix + t for t in texts])

    def embed_query(self, text: str) -> np.ndarray:
        return self._encode([self.config.query_prefix + text])[0]


#: Makers of models by provider, given the stored configuration, a batch size and a device.
PROVIDERS: dict[str, Callable[[EmbeddingModelConfig, int, str], EmbeddingModel]] = {
    "sentence-transformers": lambda c, batch, device: SentenceTransformerModel(c.model_name, batch_size=batch, device=device, query_prefix=c.query_prefix, document_prefix=c.document_prefix),
    "hashing": lambda c, batch, device: HashingEmbedder(c),
}


def create_model(config: EmbeddingModelConfig, *, batch_size: int = 32, device: str = "cpu") -> EmbeddingModel:
    if config.provider not in PROVIDERS:
        raise ValueError(f"Unsupported embedding model provider: {config.provider}")
    return PROVIDERS[config.provider](config, batch_size, device)


def embed(texts: Column, make: Callable[[], EmbeddingModel], query: bool = False) -> Column:
    """Embeddings by Arrow batches; each worker makes the model once."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        dimension = model.config.dimension
        for batch in batches:
            rows = [model.embed_query(t) for t in batch] if query else model.embed_documents(list(batch))
            if not isinstance(rows, (np.ndarray, list)):
                raise TypeError("Embedding model must return a NumPy array")
            rows = np.asarray(rows)
            if len(batch) and rows.ndim != 2:
                raise ValueError("Dense embeddings must be a two-dimensional matrix")
            if len(rows) != len(batch):
                raise ValueError("Dense embeddings row count does not match chunks count")
            if len(batch) and rows.shape[1] != dimension:
                raise ValueError("Dense embeddings dimension does not match embedding model")
            yield pd.Series(list(rows.astype(np.float32)))

    # not to be evaluated again inside the expressions that use it
    return run.asNondeterministic()(texts)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def is_finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def l2_normalize(vector: Column, zero: str = "Dense embeddings must not contain zero vectors") -> Column:
    """Unit vector in single precision; zero and non-finite vectors are errors."""
    norm = F.sqrt(dot(vector, vector))
    unit = F.transform(vector, lambda x: (x / norm).cast("float"))
    bad = F.raise_error(F.lit("Dense embeddings must contain only finite values")).cast("array<float>")
    return F.when(~is_finite(vector), bad).when(norm == 0, F.raise_error(F.lit(zero)).cast("array<float>")).otherwise(unit)


@dataclass(frozen=True)
class DenseMetadata:
    embedding_model: EmbeddingModelConfig
    chunks_sha256: str
    normalized: bool = True
    schema_version: int = SCHEMA_VERSION

    def to_dict(self) -> dict:
        return asdict(self)


def build_dense(chunks: DataFrame, make: Callable[[], EmbeddingModel], chunks_sha256: str, *, pos: str = "chunk_pos") -> tuple[DataFrame, DenseMetadata]:
    """(``chunk_pos``, ``chunk_id``, unit ``embedding``) and metadata. Chunk ids must be unique."""
    bound_batches(chunks.sparkSession)
    config = make().config
    if not chunks_sha256:
        raise ValueError("Chunks hash must not be empty")
    if chunks.groupBy("chunk_id").count().filter("count > 1").limit(1).count():
        raise ValueError("Chunk IDs must be unique")
    raw = chunks.select(F.col(pos).alias("chunk_pos"), "chunk_id", embed(F.col("searchable_text"), make).alias("embedding"))
    return raw.withColumn("embedding", l2_normalize(F.col("embedding"))), DenseMetadata(config, chunks_sha256)


class TopK:
    """Best rows of some queries over the batches of vectors that pass by: by rounded score, then by the higher position."""

    def __init__(self, names: Sequence, matrix: np.ndarray, k: int):
        self.names, self.matrix, self.k = names, matrix, k
        self.query, self.pos, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, pos: np.ndarray, held: np.ndarray, query_block: int = QUERY_BLOCK) -> None:
        """Vectors as rows of ``held``; those that can't be among a query's best are left out before anything is sorted."""
        query, at, score = [self.query], [self.pos], [self.score]
        for first in range(0, len(self.names), query_block):
            scores = self.matrix[first : first + query_block] @ held.T
            scores[np.isnan(scores)] = np.inf
            if scores.shape[1] > self.k:
                # whatever rounds to the k-th score stays
                least = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
                q, v = np.nonzero(scores >= (least - 2 * 10.0**-RANK_DECIMALS)[:, None])
            else:
                q, v = np.nonzero(np.ones(scores.shape, bool))
            query.append(q + first)
            at.append(pos[v])
            score.append(scores[q, v])
        q, p, s = np.concatenate(query), np.concatenate(at), np.concatenate(score)
        order = np.lexsort((-p, -np.round(s, RANK_DECIMALS), q))
        q, p, s = q[order], p[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        best = place < self.k
        self.query, self.pos, self.score = q[best], p[best], s[best]

    def rows(self) -> dict[str, list | np.ndarray]:
        score = np.where(np.isinf(self.score), np.nan, self.score)
        return {"query_id": [self.names[i] for i in self.query.tolist()], "chunk_pos": self.pos, "score": score}


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as doubles; lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def cosine_top_k(queries: DataFrame, vectors: DataFrame, top_k: int, *, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, chunk_pos, score, rank): exact inner products of unit vectors, best ``top_k`` of each query.

    Queries of ``query_bytes`` at most are broadcast to one scan of the vectors. More of them meet the vectors on a grid: a
    task holds a part of the vectors, past which all queries stream in blocks of that size, so each vector travels once and
    each query once for each part. Either way a task sends on ``top_k`` rows of each query, and these are merged for each
    query. Equal scores go by the higher position.
    """
    check_top_k(top_k)
    spark = vectors.sparkSession
    asked = materialise(queries.select("query_id", "embedding"), "queries")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    total = 8 * size["n"] * (size["width"] or 0)
    kind, pos_kind = queries.schema["query_id"].dataType, vectors.schema["chunk_pos"].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("chunk_pos", pos_kind), T.StructField("score", T.DoubleType())])
    if not size["n"]:
        return spark.createDataFrame([], T.StructType([*schema, T.StructField("rank", T.IntegerType())]))
    arrow = pa.schema([("query_id", to_arrow_type(kind)), ("chunk_pos", to_arrow_type(pos_kind)), ("score", pa.float64())])
    if total <= query_bytes:
        rows = asked.toArrow()
        shared = spark.sparkContext.broadcast((rows["query_id"].to_pylist(), _matrix(rows["embedding"].combine_chunks())))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = TopK(*shared.value, top_k)
            for batch in batches:
                if batch.num_rows:
                    best.add(batch.column(0).to_numpy(), _matrix(batch.column(1)))
            yield pa.RecordBatch.from_pydict(best.rows(), schema=arrow)

        found = vectors.select("chunk_pos", "embedding").mapInArrow(scan, schema)
    else:
        most = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-8 * most["n"] * (most["width"] or 0) // VECTOR_BYTES))
        at_once = max(1, query_bytes // (8 * size["width"]))
        every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        left = asked.select(every.alias("part"), "query_id", F.lit(None).cast(pos_kind).alias("chunk_pos"), "embedding")
        right = vectors.select(F.pmod(F.xxhash64("chunk_pos"), F.lit(parts)).cast("int").alias("part"), F.lit(None).cast(kind).alias("query_id"), "chunk_pos", F.col("embedding").cast(asked.schema["embedding"].dataType))
        dealt = left.union(right).repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("chunk_pos").isNull())

        def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Vectors of the part come first, then the queries, which are done with once they have passed."""
            pos, held = [], []
            for batch in batches:
                asks = pc.is_null(batch.column(1)).to_numpy(zero_copy_only=False)
                if not asks.all():
                    some = batch.filter(pa.array(~asks))
                    pos.append(some.column(1).to_numpy())
                    held.append(_matrix(some.column(2)))
                if asks.any() and held:
                    if len(held) > 1:
                        pos, held = [np.concatenate(pos)], [np.concatenate(held)]
                    some = batch.filter(pa.array(asks))
                    for first in range(0, some.num_rows, at_once):
                        block = some.slice(first, at_once)
                        best = TopK(block.column(0).to_pylist(), _matrix(block.column(2)), top_k)
                        for low in range(0, len(pos[0]), VECTOR_ROWS):
                            best.add(pos[0][low : low + VECTOR_ROWS], held[0][low : low + VECTOR_ROWS])
                        yield pa.RecordBatch.from_pydict(best.rows(), schema=arrow)

        found = dealt.select("query_id", "chunk_pos", "embedding").mapInArrow(cell, schema)
    order = W.partitionBy("query_id").orderBy(F.round("score", RANK_DECIMALS).desc(), F.desc("chunk_pos"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


class DenseIndex:
    """A retriever over (``chunk_pos``, ``chunk_id``, ``embedding``) with the model that made it."""

    def __init__(self, chunks: DataFrame, embeddings: DataFrame, metadata: DenseMetadata, make: Callable[[], EmbeddingModel]):
        self.model = make()
        if metadata.schema_version != SCHEMA_VERSION:
            raise ValueError(f"Unsupported dense index schema version: {metadata.schema_version}")
        if not metadata.normalized:
            raise ValueError("Dense index embeddings must be normalized")
        if metadata.embedding_model != self.model.config:
            raise ValueError("Embedding model configuration does not match dense index metadata")
        both = chunks.select("chunk_pos", F.col("chunk_id").alias("a")).join(embeddings.select("chunk_pos", F.col("chunk_id").alias("b"), F.size("embedding").alias("width")), "chunk_pos", "full")
        facts = both.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("rows"), F.count_if(F.col("a") != F.col("b")).alias("ids"), F.count_if(F.col("width") != metadata.embedding_model.dimension).alias("dims")).first()
        if facts["rows"]:
            raise ValueError("Dense embeddings row count does not match chunks count")
        if facts["dims"]:
            raise ValueError("Dense embeddings dimension does not match index metadata")
        if facts["ids"]:
            raise ValueError("Chunk IDs do not match dense index metadata")
        self.chunks, self.embeddings, self.make = chunks, embeddings, make

    def search(self, queries: DataFrame, top_k: int) -> DataFrame:
        """(query_id, pos, chunk_id, score, rank). A blank query is an error; negative scores are results too."""
        check_top_k(top_k)
        blank = F.when(F.trim(F.col("query")) == "", F.raise_error(F.lit("Query must not be empty")).cast("string")).otherwise(F.col("query"))
        vectors = queries.select("query_id", embed(blank, self.make, query=True).alias("raw"))
        vectors = vectors.select("query_id", l2_normalize(F.col("raw"), "Query embedding must not be a zero vector").alias("embedding"))
        # written at once: few rows, which every step behind would search for again
        hits = materialise(cosine_top_k(vectors, self.embeddings, top_k), "dense-hits")
        return named(hits, self.chunks.select("chunk_pos", "chunk_id"), "chunk_pos").select("query_id", F.col("chunk_pos").alias("pos"), "chunk_id", "score", "rank")

    retrieve = search
