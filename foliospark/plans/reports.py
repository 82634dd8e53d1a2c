"""Evaluation of retrieval indices: quality, latency, payload, fingerprints, and the contracts of reports."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.numeric import clamp_min
from foliospark.operators import dense, fingerprints, maxsim, metrics, pooling, ranking, samples
from foliospark.operators.validate import ContractError, require_none
from foliospark.plans.evaluation import RetrievalIndex, top_k_padded
from foliospark.session import checkpointed


def payload(tokens: DataFrame, width: int, value_bytes: int = 4, item: str = "document_id") -> DataFrame:
    """One row: bytes of all token vectors with their masks and of one mean vector a page, of a page on average, and their ratio.

    Positions count once; masked ones are stored as well.
    """
    once = tokens.groupBy(item, "pos").agg(F.lit(1).alias("one"))
    sizes = once.agg(F.count(F.lit(1)).alias("positions"), F.count_distinct(item).alias("pages"))
    many, one = F.col("positions") * F.lit(width * value_bytes + 1), F.col("pages") * F.lit(width * value_bytes)
    return sizes.select(
        "pages", many.alias("token_bytes"), one.alias("mean_bytes"), (many / F.nullif("pages", F.lit(0))).alias("token_bytes_per_page"), (one / F.nullif("pages", F.lit(0))).alias("mean_bytes_per_page"), (many / F.nullif(one, F.lit(0))).alias("ratio")
    )


def coverage_violations(ranked: DataFrame, qrels: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """What keeps a ranking from being measured by these judgements: id, what.

    Queries that only one side has (``unjudged``, ``unranked``), and, given the documents, judged ones that aren't
    among them (``unknown``).  A metric over such input would be over another set of queries than it says.
    """
    asked, judged = ranked.select("query_id").distinct(), qrels.select("query_id").distinct()
    found = asked.join(judged, "query_id", "left_anti").select(F.col("query_id").alias("id"), F.lit("unjudged").alias("what"))
    found = found.union(judged.join(asked, "query_id", "left_anti").select(F.col("query_id").alias("id"), F.lit("unranked").alias("what")))
    if documents is not None:
        unknown = qrels.select("document_id").distinct().join(documents.select("document_id").distinct(), "document_id", "left_anti")
        found = found.union(unknown.select(F.col("document_id").alias("id"), F.lit("unknown").alias("what")))
    return found


def strict_metrics(ranked: DataFrame, qrels: DataFrame, k: int = 5, documents: DataFrame | None = None) -> DataFrame:
    """``metrics.retrieval_metrics`` after checking that ranking and judgements name the same queries, and known documents."""
    require_none(coverage_violations(ranked, qrels, documents), "ranking and judgements differ")
    return metrics.retrieval_metrics(ranked, qrels, k)


@dataclass(frozen=True)
class Timing:
    """Seconds of a first, cold call, and of the calls that count, one a query."""

    cold: float
    calls: tuple[float, ...]


def timed(index: RetrievalIndex, queries: DataFrame, documents: DataFrame, k: int, warmups: int, calls: int) -> Timing:
    """Times single queries through an index, after a cold call and ``warmups`` more; at most ``calls`` of the first by id."""
    ids = [r[0] for r in queries.select("query_id").distinct().orderBy("query_id").limit(max(calls, 1)).collect()]
    if not ids:
        return Timing(0.0, ())

    def call(q: str) -> float:
        started = time.perf_counter()
        one = queries.where(F.col("query_id") == q)
        top_k_padded(index.score(one), one, documents, k).collect()
        return time.perf_counter() - started

    cold = call(ids[0])
    for _ in range(warmups):
        call(ids[0])
    return Timing(cold, tuple(call(q) for q in ids[:calls]))


def scorer_result(name: str, ranked: DataFrame, qrels: DataFrame, k: int, index_bytes: int, timing: Timing | None = None, documents: int | None = None) -> dict:
    """The report of one scorer: metrics at k, latency in ms, pairs per second, bytes, the fingerprint and lists of its best k.

    The lists have a row a query, and the queries of an evaluation are a stated set.
    """
    row = metrics.retrieval_metrics(ranked, qrels, k).first().asDict()
    lists = ranking.top_lists(ranked, k).orderBy("query_id").collect()
    top = {r["query_id"]: list(r["documents"]) for r in lists}
    report: dict = {"scorer": name, "k": k, "metrics": row, "index_bytes": index_bytes, "top_k": top, "fingerprint": fingerprints.canonical_digest({"k": k, "scorer": name, "top_k": top})}
    if timing and timing.calls:
        calls = sorted(1000 * c for c in timing.calls)
        at = lambda q: (lambda p: calls[int(p)] + (p - int(p)) * (calls[min(int(p) + 1, len(calls) - 1)] - calls[int(p)]))(q * (len(calls) - 1))
        report["latency_ms"] = {"cold": 1000 * timing.cold, "p50": at(0.5), "p95": at(0.95), "mean": sum(calls) / len(calls), "calls": len(calls)}
        if documents:
            report["pairs_per_second"] = documents * len(calls) / sum(timing.calls)
    return report


def evaluate_index(name: str, index: RetrievalIndex, queries: DataFrame, documents: DataFrame, qrels: DataFrame, k: int = 5, index_bytes: int = 0, warmups: int = 1, calls: int = 5) -> dict:
    """Quality over all judged queries in one job, latency of single queries, and the end-to-end rate of the whole job."""
    known = queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    started = time.perf_counter()
    ranked = checkpointed(top_k_padded(index.score(known), known, documents, k))
    whole = time.perf_counter() - started
    size = documents.select("document_id").distinct().count()
    report = scorer_result(name, ranked, qrels, k, index_bytes, timed(index, known, documents, k, warmups, calls), size)
    report["end_to_end_pairs_per_second"] = size * known.select("query_id").distinct().count() / whole
    return report


def evaluate_pair(queries: DataFrame, documents: DataFrame, qrels: DataFrame, width: int, k: int = 5) -> dict[str, dict]:
    """Late interaction and mean vectors over the same queries and pages, from one table of token vectors each."""
    asked = checkpointed(queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi"))
    pages = checkpointed(documents)
    sizes = payload(pages, width).first()
    scores = {
        "late_interaction": maxsim.maxsim(asked, pages, width, k=k),
        "mean_vectors": dense.scores(pooling.mean_pool(asked, "query_id", width).withColumnRenamed("vector", "emb"), pooling.mean_pool(pages, width=width).withColumnRenamed("vector", "emb"), width, k=k),
    }
    stored = {"late_interaction": sizes["token_bytes"], "mean_vectors": sizes["mean_bytes"]}
    return {name: scorer_result(name, checkpointed(ranking.rank_scores(found, k=k)), qrels, k, stored[name]) for name, found in scores.items()}


def recomputed_timings(raw: DataFrame, reported: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Reported figures (workload, candidate, p50, total) that the raw samples don't give: both, side by side.

    A figure agrees if it differs by at most ``tolerance`` of the greater one.
    """
    own = samples.workload_p50(raw).select("workload", "candidate", F.col("p50").alias("own_p50"), F.col("total").alias("own_total"))
    both = own.join(reported.select("workload", "candidate", "p50", "total"), ["workload", "candidate"], "full")
    close = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= F.lit(tolerance) * F.greatest(F.abs(F.col(a)), F.abs(F.col(b))), F.lit(False))
    return both.where(~(close("own_p50", "p50") & close("own_total", "total")))


def accepted(rows: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """``rows`` with a column for each condition, null taken as failed, and ``accepted`` if all hold."""
    checks = {name: F.coalesce(c, F.lit(False)) for name, c in conditions.items()}
    whole = F.lit(True)
    for c in checks.values():
        whole = whole & c
    return rows.select("*", *[c.alias(name) for name, c in checks.items()], whole.alias("accepted"))


def relative_gain(new: Column, old: Column) -> Column:
    """How much ``new`` is above ``old``, in parts of ``old``."""
    return (new - old) / clamp_min(F.abs(old), 1e-12)


@dataclass(frozen=True)
class Encoded:
    """A table of token vectors and what it holds: queries (query_id) or documents (document_id)."""

    tokens: DataFrame
    role: str

    def __post_init__(self) -> None:
        if self.role not in ("query", "document"):
            raise ContractError(f"unknown role {self.role!r}")
        if f"{self.role}_id" not in self.tokens.columns:
            raise ContractError(f"a {self.role} table needs {self.role}_id")


def late_interaction(queries: Encoded, documents: Encoded, width: int, **options) -> DataFrame:
    """``maxsim.maxsim`` of tables whose roles are checked, so that the sum is over query tokens."""
    if queries.role != "query" or documents.role != "document":
        raise ContractError("scores are of queries against documents")
    return maxsim.maxsim(queries.tokens, documents.tokens, width, **options)
