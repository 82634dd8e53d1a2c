"""nDCG, recall and reciprocal rank at a cutoff, macro-averaged over queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.ranking import check_k


def query_metrics(ranked: DataFrame, qrels: DataFrame, k: int = 5, groups: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """ndcg, recall, reciprocal_rank and first_relevant of every query with a relevant document.

    Gains are binary, discounted by log2(rank + 1); the ideal gain is over min(k, relevant) documents, and
    recall is over all relevant ones.  Repeated qrels count once.  A query that ranks nothing scores 0 in
    each group that the ranking has.
    """
    check_k(k)
    relevant = qrels.select("query_id", "document_id").where("query_id is not null and document_id is not null").distinct()
    counts = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    outer = [g for g in groups if g != "query_id"]
    frame = ranked.select(*outer, "query_id").distinct().join(counts, "query_id")
    hits = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "document_id"], "left_semi")
    gains = hits.groupBy(*groups).agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first_relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    return frame.join(gains, list(groups), "left").select(
        *groups,
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        (F.coalesce("hits", F.lit(0)) / F.col("relevant")).alias("recall"),
        F.coalesce(1 / F.col("first_relevant"), F.lit(0.0)).alias("reciprocal_rank"),
        "first_relevant",
        "relevant",
    )


def retrieval_metrics(ranked: DataFrame, qrels: DataFrame, k: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each ``by``): ndcg_at_k, recall_at_k, mrr_at_k and the number of queries."""
    each = query_metrics(ranked, qrels, k, (*by, "query_id"))
    summary = [F.avg("ndcg").alias(f"ndcg_at_{k}"), F.avg("recall").alias(f"recall_at_{k}"), F.avg("reciprocal_rank").alias(f"mrr_at_{k}"), F.count(F.lit(1)).alias("queries")]
    return each.groupBy(*by).agg(*summary) if by else each.agg(*summary)
