"""BM25 over chunks: postings, document frequencies and batched top-k."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokenize

#: Query terms up to which they are broadcast; beyond, terms are shuffled.
BROADCAST_TERMS = 100_000
#: Hits (some 50 bytes each) up to which they are broadcast to the chunks.
BROADCAST_HITS = 200_000
#: Decimals of the ranking key: equal texts must tie whatever the order of summation.
RANK_DECIMALS = 9
#: Positions of a block of postings.
BLOCK_ROWS = 64


def check_top_k(top_k: int) -> None:
    if top_k < 1:
        raise ValueError(f"top_k must be at least 1, got {top_k}")


def check_parameters(k1: float, b: float) -> None:
    if not k1 > 0:
        raise ValueError(f"k1 must be greater than 0, got {k1}")
    if not 0 <= b <= 1:
        raise ValueError(f"b must be between 0 and 1, got {b}")


def named(hits: DataFrame, chunks: DataFrame, pos: str) -> DataFrame:
    """``hits`` with the columns of their ``chunks``, by ``pos``: up to ``BROADCAST_HITS`` hits go to the chunks, so nothing of other chunks travels."""
    few = hits.count() <= BROADCAST_HITS
    return chunks.join(F.broadcast(hits) if few else hits, pos)


def tokenized(docs: DataFrame, pos: str, text: str, exact: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(pos, tokens, dl) of every row, rows without tokens included, and the columns in ``keep``."""
    tokens = docs.select(F.col(pos).alias("pos"), *keep, F.coalesce(tokenize(F.col(text), exact), F.array().cast("array<string>")).alias("tokens"))
    return tokens.select("pos", *keep, "tokens", F.size("tokens").alias("dl"))


def postings(tokens: DataFrame) -> DataFrame:
    """(pos, dl, term, tf). Terms of a row stay in one task: map-side aggregation does nearly all."""
    return tokens.select("pos", "dl", F.explode("tokens").alias("term")).groupBy("pos", "dl", "term").agg(F.count("*").alias("tf"))


def counted_terms(tokens: DataFrame, *columns: str) -> DataFrame:
    """(*columns, term, tf) of every row: equal tokens stand together when sorted, so a row counts its own and nothing is shuffled."""
    ordered = tokens.select(*columns, F.array_sort("tokens").alias("t")).filter(F.size("t") > 0)
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    runs = ordered.select(*columns, "t", starts.alias("s"))
    pairs = F.transform("s", lambda i, nth: F.struct(F.get("t", i).alias("term"), (F.coalesce(F.get("s", nth + 1), F.size("t")) - i).cast("long").alias("tf")))
    return runs.select(*columns, F.inline(pairs))


def document_frequencies(tokens: DataFrame) -> DataFrame:
    """(term, df): rows that hold the term."""
    return tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_size(tokens: DataFrame) -> DataFrame:
    """One row: number of rows and mean length, rows without tokens included."""
    return tokens.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def idf(n, df):
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def best_chunks(scores: DataFrame, top_k: int) -> DataFrame:
    """(query_id, pos, chunk_id, score, rank) of the best ``top_k`` positive scores of each query."""
    order = W.partitionBy("query_id").orderBy(F.round("score", RANK_DECIMALS).desc(), "chunk_id", "pos")
    ranked = scores.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    return ranked.select("query_id", "pos", "chunk_id", "score", "rank")


#: Stands for the row itself among its terms; no token is empty.
ROW = ""


@dataclass
class BM25Index:
    """A retriever over (``pos``, ``chunk_id``, ...) chunks. Nothing is computed before a search.

    A search tokenises the chunks once.  What it keeps of them, the counts of its queries' terms and one number for
    each row, is persisted, since weights need it before scores do; ``close`` lets it go.
    """

    chunks: DataFrame
    tokens: DataFrame
    k1: float = 1.5
    b: float = 0.75
    held: list[DataFrame] = field(default_factory=list)

    @classmethod
    def build(cls, chunks: DataFrame, *, pos: str = "chunk_pos", text: str = "searchable_text", k1: float = 1.5, b: float = 0.75, exact: bool = False) -> BM25Index:
        check_parameters(k1, b)
        return cls(chunks.withColumnRenamed(pos, "pos"), tokenized(chunks, pos, text, exact, ("chunk_id",)), k1, b)

    def _matched(self, queries: DataFrame, exact: bool) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
        """(query_id, term) of the queries, (pos, chunk_id, term, part) of the chunks that hold one of the terms, and how the first is joined.

        ``part`` is what the term adds to the score of a query that has it. Only terms of the queries leave the scan.
        """
        asked = queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("query"), exact))).alias("term")).persist()
        few = asked.count() <= BROADCAST_TERMS
        hint = F.broadcast if few else (lambda x: x)
        terms = asked.select("term").distinct()
        # each row passes once for itself, so the same scan gives the corpus size
        tokens = self.tokens.withColumn("tokens", F.array_append("tokens", F.lit(ROW))) if few else self.tokens
        wanted = F.broadcast(terms.union(terms.sparkSession.range(1).select(F.lit(ROW)))) if few else terms
        # terms of a row go to one task together, where its scores are summed without another shuffle
        counted = counted_terms(tokens, "pos", "chunk_id", "dl").join(wanted, "term").select("pos", "chunk_id", "dl", "term", "tf").repartition("pos").persist()
        self.held += [asked, counted]
        tf = counted.filter(F.col("term") != ROW)
        size = corpus_size(counted.filter(F.col("term") == ROW) if few else self.tokens)  # one row
        df = tf.groupBy("term").agg(F.count("*").alias("df"))
        weights = df.crossJoin(F.broadcast(size)).select("term", idf(F.col("n"), F.col("df")).alias("idf"), "avgdl")
        ratio = F.when(F.col("avgdl") == 0, F.lit(0.0)).otherwise(F.col("dl") / F.col("avgdl"))
        part = F.col("idf") * (F.col("tf") * F.lit(self.k1 + 1.0)) / (F.col("tf") + F.lit(self.k1) * (F.lit(1.0 - self.b) + F.lit(self.b) * ratio))
        return asked, tf.join(hint(weights), "term").select("pos", "chunk_id", "term", part.alias("part")), hint

    def search(self, queries: DataFrame, top_k: int, exact: bool = False) -> DataFrame:
        """(query_id, pos, chunk_id, score, rank) for all queries in one plan; queries without terms have no hits. Scores are partial sums per row."""
        check_top_k(top_k)
        asked, parts, hint = self._matched(queries, exact)
        scores = parts.join(hint(asked), "term").groupBy("query_id", "pos", "chunk_id").agg(F.sum("part").alias("score"))
        return best_chunks(scores, top_k)

    def search_bounded(self, queries: DataFrame, top_k: int, exact: bool = False, *, rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
        """(the rows of ``search``, (query_id, ``blocks``, ``visited``)): blocks of postings that can't matter are skipped.

        A block is a term's postings in a range of ``rows`` positions, with the largest part among them. The sum of
        those bounds what a query can score in a range. The ranges with the highest bounds are scored first; all others
        whose bound is below the k-th score found there are never opened. Every term counts in the ranges that are.
        """
        check_top_k(top_k)
        asked, parts, hint = self._matched(queries, exact)
        place = F.floor(F.col("pos") / rows).alias("range")
        blocks = parts.groupBy("term", place).agg(F.max("part").alias("top"), F.collect_list(F.struct("pos", "chunk_id", "part")).alias("rows")).persist()
        bounds = blocks.select("term", "range", "top").join(hint(asked), "term").groupBy("query_id", "range").agg(F.sum("top").alias("bound"), F.count("*").alias("terms")).persist()
        self.held += [blocks, bounds]

        def scored(pairs: DataFrame) -> DataFrame:
            opened = pairs.select("query_id", "range").join(hint(asked), "query_id").join(blocks, ["term", "range"])
            return opened.select("query_id", F.inline("rows")).groupBy("query_id", "pos", "chunk_id").agg(F.sum("part").alias("score"))

        order = W.partitionBy("query_id").orderBy(F.desc("bound"), "range")
        first = bounds.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= top_k)
        least = best_chunks(scored(first), top_k).filter(F.col("rank") == top_k).select("query_id", F.col("score").alias("least"))
        # sums of the same parts in another order differ by far less
        left = bounds.join(hint(least), "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - F.lit(1e-6)))
        counts = bounds.groupBy("query_id").agg(F.sum("terms").alias("blocks")).join(left.groupBy("query_id").agg(F.sum("terms").alias("visited")), "query_id", "left")
        return best_chunks(scored(left), top_k), counts.select("query_id", "blocks", F.coalesce("visited", F.lit(0)).alias("visited"))

    retrieve = search

    def close(self) -> None:
        while self.held:
            self.held.pop().unpersist()
