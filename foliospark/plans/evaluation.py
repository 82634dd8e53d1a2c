"""End-to-end evaluation: scores to rankings, metrics and reports, for one or several scorers."""

from __future__ import annotations

import time
from collections.abc import Mapping
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import chunk_windows
from foliospark.operators import bm25, dense, metrics, ranking
from foliospark.session import numbered, written


class RetrievalIndex(Protocol):
    """Anything that scores queries (query_id, text) as query_id, document_id, score."""

    def score(self, queries: DataFrame) -> DataFrame: ...


class TextEncoder(Protocol):
    """Anything that adds a vector column ``emb`` to a DataFrame with a column ``text``."""

    def encode(self, texts: DataFrame) -> DataFrame: ...


class Bm25Index:
    """BM25 as a retrieval index."""

    def __init__(self, documents: DataFrame, **options):
        self.index = bm25.build(documents, **options)

    def score(self, queries: DataFrame) -> DataFrame:
        """Non-zero page scores."""
        return bm25.scores(self.index, queries)


class DenseIndex:
    """Windows of texts as vectors of an encoder, the best cosine of a page's windows as its score."""

    def __init__(self, documents: DataFrame, encoder: TextEncoder, width: int, max_words: int = 192, overlap: int = 32):
        windows = chunk_windows(documents.select("document_id", "text"), "text", max_words, overlap)
        texts = windows.select("document_id", F.array_join("words", " ").alias("text"))
        self.encoder, self.width, self.chunks = encoder, width, written(encoder.encode(texts).select("document_id", "emb"))

    def score(self, queries: DataFrame) -> DataFrame:
        """Scores of all pages that have a window."""
        asked = self.encoder.encode(queries.where("query_id is not null and text is not null").select("query_id", "text"))
        return dense.scores(asked.select("query_id", "emb"), self.chunks, self.width)


def top_k_padded(scores: DataFrame, queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """The first k of each query's complete ranking, from scores without the zeros.

    A page that doesn't come out scores 0 and ranks by its id, before any page that scores below 0.  Of the 2k
    greatest ids a query's k - 1 best matches can take k - 1 at most, and each match below 0 one more: so each
    query is padded from its 2k + (matches below 0) greatest ids.  Where no query has a match below 0 these ids
    are one short list; else each query meets the pages by their place from the greatest id down.
    """
    scores = written(scores.select("query_id", "document_id", "score"))
    best = ranking.rank_scores(scores, k=k)
    asked, ids = queries.select("query_id").where("query_id is not null").distinct(), documents.select("document_id").where("document_id is not null").distinct()
    below = scores.where("score < 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("below"))
    if below.isEmpty():
        spare = ids.orderBy(F.desc("document_id")).limit(2 * k).agg(F.collect_list("document_id").alias("spare"))
        padded = asked.withColumn("spare", spare.scalar()).select("query_id", F.explode("spare").alias("document_id"))
    else:
        placed = numbered(ids, "document_id", "from_least")
        placed = placed.select("document_id", (F.lit(ids.count() - 1) - F.col("from_least")).alias("place"))
        wanted = asked.join(below, "query_id", "left").select("query_id", F.explode(F.sequence(F.lit(0), F.lit(2 * k - 1) + F.coalesce("below", F.lit(0)).cast("int"))).alias("place"))
        padded = wanted.join(placed, "place").select("query_id", "document_id")
    zeros = padded.join(scores, ["query_id", "document_id"], "left_anti").withColumn("score", F.lit(0.0))
    return ranking.rank_scores(best.select("query_id", "document_id", "score").unionByName(zeros), k=k)


def evaluate(index: RetrievalIndex, queries: DataFrame, documents: DataFrame, qrels: DataFrame, k: int = 5) -> dict:
    """Metrics at k and the time they took, over queries with a positive."""
    known = queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    started = time.perf_counter()
    ranked = top_k_padded(index.score(known), known, documents, k)
    row = metrics.retrieval_metrics(ranked, qrels, k).first().asDict()
    return row | {"seconds": time.perf_counter() - started}


def compare(scorers: Mapping[str, DataFrame], qrels: DataFrame, k: int = 5) -> DataFrame:
    """Metrics of several scorers over the same queries, one row each."""
    parts = [metrics.retrieval_metrics(ranking.rank_scores(scores, k=k), qrels, k).withColumn("scorer", F.lit(name)) for name, scores in sorted(scorers.items())]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
