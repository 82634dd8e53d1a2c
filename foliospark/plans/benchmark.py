"""Benchmarks of scoring: results are compared before anything is timed."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import samples, synthetic
from foliospark.operators.validate import ContractError
from foliospark.sources.config import BenchmarkConfig, Case

#: A way of scoring: queries and documents (id, pos, mask, emb) and their width to query_id, document_id, score.
Provider = Callable[[DataFrame, DataFrame, int], DataFrame]


def tables(spark: SparkSession, case: Case, seed: int) -> tuple[DataFrame, DataFrame]:
    """Seeded token tables of a case."""
    queries = synthetic.token_table(spark, case.queries, case.query_tokens, case.width, case.active_query_tokens, seed, item="query_id")
    return queries, synthetic.token_table(spark, case.documents, case.document_tokens, case.width, case.active_document_tokens, seed + 10_000)


def run_once(df: DataFrame) -> float:
    """Seconds to compute all of a result, without keeping it."""
    started = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def measure(spark: SparkSession, config: BenchmarkConfig, providers: Mapping[str, Provider], reference: str) -> DataFrame:
    """Every case with every provider: candidate, workload, call (cold or trial), trial and latency_ms.

    A provider whose scores of a case aren't close to the reference's raises; only then it is timed: one cold call,
    warmups that don't count, and the trials.
    """
    rows: list[tuple[str, str, str, int, float]] = []
    for case in config.cases:
        queries, documents = (df.cache() for df in tables(spark, case, config.seed))
        try:
            expected = providers[reference](queries, documents, case.width)
            for name, provider in sorted(providers.items()):
                cold = run_once(provider(queries, documents, case.width))
                if name != reference:
                    found = samples.agreement(provider(queries, documents, case.width), expected, ["query_id", "document_id"], config.absolute_tolerance, config.relative_tolerance).first()
                    if found["pairs"] != case.queries * case.documents or not found["all_close"]:
                        raise ContractError(f"{name} differs from {reference} in {case.name}: {found.asDict()}")
                rows.append((name, case.name, "cold", 0, 1000 * cold))
                for _ in range(config.warmups):
                    run_once(provider(queries, documents, case.width))
                rows += [(name, case.name, "trial", t, 1000 * run_once(provider(queries, documents, case.width))) for t in range(config.trials)]
        finally:
            queries.unpersist()
            documents.unpersist()
    return spark.createDataFrame(rows, "candidate string, workload string, call string, trial int, latency_ms double")


def summary(measured: DataFrame) -> DataFrame:
    """Candidates in order of relative latency over the trials; see ``samples.candidate_ranking``."""
    return samples.candidate_ranking(measured.where(F.col("call") == "trial"))
