"""Complete deterministic rankings and their contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.numeric import is_finite
from foliospark.session import numbered_within


def check_k(k: int) -> int:
    """``k`` must be a positive integer."""
    if isinstance(k, bool) or not isinstance(k, int):
        raise TypeError("k must be an integer")
    if k <= 0:
        raise ValueError("k must be positive")
    return k


def rank_scores(scores: DataFrame, groups: tuple[str, ...] = ("query_id",), score: str = "score", item: str = "document_id", k: int | None = None) -> DataFrame:
    """``scores`` with ``rank`` (from 1): score descending, then item descending by code point.

    With ``k`` only the first k of each group come out, and Spark limits the groups before the shuffle.  A complete
    ranking is range-partitioned, so that a query with most of the rows is many tasks.
    Rows with a score that isn't finite are left out; validate first to reject them.
    """
    finite, order = scores.where(is_finite(F.col(score))), [F.desc(score), F.desc(item)]
    if k is None:
        return numbered_within(finite, list(groups), order, "rank").withColumn("rank", F.col("rank").cast("int"))
    ranked = finite.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col("rank") <= check_k(k))


def top_lists(ranked: DataFrame, k: int, groups: tuple[str, ...] = ("query_id",), item: str = "document_id") -> DataFrame:
    """The first k items of each group as an ordered list ``documents``."""
    kept = ranked.where(F.col("rank") <= check_k(k)).groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("rank", item))).alias("list"))
    return kept.select(*groups, F.transform("list", lambda x: x[item]).alias("documents"))


def score_violations(scores: DataFrame, groups: tuple[str, ...] = ("query_id",), score: str = "score", item: str = "document_id") -> DataFrame:
    """Groups whose scores can't be ranked: how many are not finite, and how many items are repeated or missing."""
    bad = scores.groupBy(*groups).agg(
        F.count_if(~is_finite(F.col(score))).alias("not_finite"),
        (F.count(item) - F.count_distinct(item)).alias("repeated"),
        F.count_if(F.col(item).isNull()).alias("missing"),
    )
    return bad.where("not_finite > 0 or repeated > 0 or missing > 0")


def incomplete(ranked: DataFrame, corpus_size: int, groups: tuple[str, ...] = ("query_id",), item: str = "document_id") -> DataFrame:
    """Groups that don't rank the whole corpus."""
    return ranked.groupBy(*groups).agg(F.count_distinct(item).alias("ranked")).where(F.col("ranked") != corpus_size)
