"""Salted-hash subsets: queries, all their positives, and distractors up to a capacity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.validate import ContractError, with_row_index
from foliospark.session import bounded_rows, checkpointed


def hash_rank(salt: Column | str, kind: str, item: str) -> Column:
    """The digest by which items are ordered: SHA-256 of salt, kind and item, with zero bytes between."""
    return F.sha2(F.concat_ws("\0", F.lit(salt) if isinstance(salt, str) else salt, F.lit(kind), F.col(item)), 256)


def trial_order(seed: str, workload: Column, trial: Column, candidate: Column) -> Column:
    """The digest by which candidates of a trial are shuffled."""
    return F.sha2(F.concat_ws("\0", F.lit(seed), workload, trial.cast("string"), candidate), 256)


def stable_seed(text: Column) -> Column:
    """The first eight bytes of a SHA-256, big endian, modulo 2^63 - 1."""
    whole = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (whole % F.lit(2**63 - 1).cast("decimal(20,0)")).cast("bigint")


def first_by_hash(items: DataFrame, item: str, salt: str, kind: str, n: int) -> DataFrame:
    """The first n items by hash, ties by item: a top-n without a full sort."""
    return items.select(item).distinct().withColumn("hash", hash_rank(salt, kind, item)).orderBy("hash", item).limit(n)


@dataclass(frozen=True)
class Selection:
    """How many queries and documents of a task a subset takes, and by which salt."""

    task: str
    salt: str
    queries: int
    documents: int

    def __post_init__(self) -> None:
        if not self.task or not self.salt:
            raise ContractError("a selection needs a task and a salt")
        for value in (self.queries, self.documents):
            if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
                raise ContractError("a selection takes positive numbers of queries and documents")


def selections_of(table: DataFrame) -> list[Selection]:
    """The selections of a table (task, salt, queries_per_task, documents_per_task; at most 200 rows, checked); a task may occur once."""
    rows = bounded_rows(table.select("task", "salt", "queries_per_task", "documents_per_task"), 200, "the table of selections")
    found = sorted((Selection(*r) for r in rows), key=lambda s: s.task)
    if len({s.task for s in found}) < len(found):
        raise ContractError("a task has several selections")
    return found


def select_subsets(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, selections: list[Selection], strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """The subsets of all selections in one plan: (task, query_id, hash) and (task, document_id, hash, positive).

    ``corpus`` (task, document_id), ``queries`` (task, query_id), ``qrels`` (query_id, document_id).  The first
    queries of each task by salted hash are taken, then all their positives, then other documents by hash up to
    the capacity.  Rankings are cut to the largest capacity within each task before the shuffle, so a task with
    most rows is split.

    ``strict`` raises if a task has too few queries or documents, if a selected query has no positive or one
    outside its task's documents, or if the positives exceed the capacity.  Otherwise a task that is too small
    gives all it has, queries without a positive in their task are left out, and positives beyond the capacity
    give way by hash.
    """
    spark = corpus.sparkSession
    table = F.broadcast(spark.createDataFrame([(s.task, s.salt, s.queries, s.documents) for s in selections], "task string, salt string, n_queries int, n_documents int"))
    pages = corpus.select("task", "document_id").where("document_id is not null").distinct()
    judged = qrels.select("query_id", "document_id").where("query_id is not null and document_id is not null").distinct()
    asked = queries.select("task", "query_id").where("query_id is not null").distinct()
    if not strict:
        judged = judged.join(pages, "document_id")
        asked = asked.join(judged.select("task", "query_id").distinct(), ["task", "query_id"], "left_semi")

    def first(items: DataFrame, item: str, kind: str, count: str, order: list[Column]) -> DataFrame:
        hashed = items.join(table, "task").withColumn("hash", hash_rank(F.col("salt"), kind, item))
        place = F.row_number().over(Window.partitionBy("task").orderBy(*order, "hash", item))
        most = max((s.queries if count == "n_queries" else s.documents for s in selections), default=0)
        return hashed.withColumn("place", place).where((F.col("place") <= most) & (F.col("place") <= F.col(count)))

    chosen = checkpointed(first(asked, "query_id", "query", "n_queries", []).select("task", "query_id", "hash"))
    required = chosen.select("task", "query_id").join(judged, "query_id" if strict else ["task", "query_id"]).select("task", "query_id", "document_id")
    marked = pages.join(required.select("task", "document_id").distinct().withColumn("positive", F.lit(True)), ["task", "document_id"], "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    documents = first(marked, "document_id", "document", "n_documents", [F.desc("positive")]).select("task", "document_id", "hash", "positive")
    if strict:
        _require_whole(chosen, required, pages, selections)
    return chosen, documents


def _require_whole(chosen: DataFrame, required: DataFrame, pages: DataFrame, selections: list[Selection]) -> None:
    """Raise where a selection can't be met; one row a task comes to the driver."""
    answered = required.select("task", "query_id").distinct()
    counts = (
        chosen.select("task", F.lit("queries").alias("what")).union(answered.select("task", F.lit("answered")))
        .union(required.select("task", "document_id").distinct().select("task", F.lit("positives")))
        .union(required.join(pages, ["task", "document_id"], "left_anti").select("task", F.lit("unknown")))
        .union(pages.where(F.col("task").isin([s.task for s in selections])).select("task", F.lit("documents")))
    )
    found = {(r["task"], r["what"]): r["count"] for r in counts.groupBy("task", "what").count().collect()}
    for s in selections:
        n = lambda what: found.get((s.task, what), 0)  # noqa: B023, E731
        if n("queries") < s.queries:
            raise ContractError(f"{s.task}: not enough queries for the subset")
        if n("answered") < n("queries") or n("unknown"):
            raise ContractError(f"{s.task}: a selected query has no positive document, or an unknown one")
        if n("positives") > s.documents:
            raise ContractError(f"{s.task}: positives exceed the capacity of the subset")
        if n("documents") < s.documents:
            raise ContractError(f"{s.task}: not enough documents for the subset")


def select_subset(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, salt: str, n_queries: int, n_documents: int) -> tuple[DataFrame, DataFrame]:
    """The strict subset of one task: selected (query_id, hash) and (document_id, hash, positive)."""
    task = F.lit("all").alias("task")
    found = select_subsets(corpus.select(task, "document_id"), queries.select(task, "query_id"), qrels, [Selection("all", salt, n_queries, n_documents)])
    return found[0].drop("task"), found[1].drop("task")


def in_source_order(selected: DataFrame, source: DataFrame, item: str) -> DataFrame:
    """``selected`` with ``row_index``, the place of each item in its scanned source: the order in which a subset is read."""
    return selected.join(with_row_index(source).groupBy(F.col(f"`{item}`").cast("string").alias(item)).agg(F.min("row_index").alias("row_index")), item)
