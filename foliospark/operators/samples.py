"""Latency summaries, candidate selection, agreement and length statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.numeric import clamp_min, is_finite, max_abs


def latency_summary(samples: DataFrame, latency: str, documents: int, pairs: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, extremes, mean, population deviation, exact percentiles and throughputs of positive latencies in ms."""
    ms = F.col(latency)
    rate = lambda work: F.lit(float(work)) / (ms / 1000.0)
    columns = [
        F.count(F.lit(1)).alias("samples"), F.min(ms).alias("minimum"), F.avg(ms).alias("mean"), F.stddev_pop(ms).alias("standard_deviation"),
        F.percentile(ms, F.lit(0.5)).alias("p50"), F.percentile(ms, F.lit(0.95)).alias("p95"), F.max(ms).alias("maximum"),
    ]
    for name, work in (("documents", documents), ("pairs", pairs)):
        columns += [
            (F.count(F.lit(1)) * F.lit(float(work)) / (F.sum(ms) / 1000.0)).alias(f"{name}_per_second"),
            F.avg(rate(work)).alias(f"{name}_per_second_mean"),
            F.percentile(rate(work), F.lit(0.5)).alias(f"{name}_per_second_p50"),
        ]
    good = samples.where(is_finite(ms) & (ms > 0))
    return good.groupBy(*by).agg(*columns) if by else good.agg(*columns)


def workload_p50(samples: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """Median and total latency of each candidate in each workload."""
    return samples.groupBy("workload", "candidate").agg(F.percentile(latency, F.lit(0.5)).alias("p50"), F.sum(latency).alias("total"))


def workload_winners(samples: DataFrame) -> DataFrame:
    """For each workload the candidate of the least median, ties to the lesser id."""
    best = workload_p50(samples).groupBy("workload").agg(F.min(F.struct("p50", "candidate")).alias("best"))
    return best.select("workload", F.col("best.candidate").alias("winner"), F.col("best.p50").alias("winner_p50"))


def candidate_ranking(samples: DataFrame) -> DataFrame:
    """Candidates by median relative p50, total latency and id; those that lack a workload come last, by id."""
    p50 = workload_p50(samples)
    relative = p50.withColumn("relative", F.col("p50") / F.min("p50").over(Window.partitionBy("workload")))
    required = p50.agg(F.count_distinct("workload").alias("n")).scalar()
    rolled = relative.groupBy("candidate").agg(
        F.percentile("relative", F.lit(0.5)).alias("median_relative_p50"), F.avg("relative").alias("mean_relative_p50"), F.sum("total").alias("total_ms"), F.count(F.lit(1)).alias("workloads")
    )
    rolled = rolled.withColumn("eligible", F.col("workloads") == required)
    order = Window.orderBy(F.desc("eligible"), F.when(F.col("eligible"), F.col("median_relative_p50")), F.when(F.col("eligible"), F.col("total_ms")), "candidate")
    return rolled.withColumn("place", F.row_number().over(order))


def candidate_rollup(samples: DataFrame, kind: str, maxima: tuple[str, ...] = ()) -> DataFrame:
    """Pooled figures of each candidate over all kinds and for each kind, in one pass of grouping sets; of the columns ``maxima`` the greatest values."""
    sets = samples.groupingSets([["candidate"], ["candidate", kind]], "candidate", kind)
    return sets.agg(*[F.max(c).alias(f"greatest_{c}") for c in maxima], F.percentile("latency_ms", F.lit(0.5)).alias("p50"), F.sum("latency_ms").alias("total"), F.count(F.lit(1)).alias("samples"), F.grouping(kind).alias("overall"))


def agreement_or_null(actual: DataFrame, expected: DataFrame, keys: list[str], atol: float, rtol: float, by: tuple[str, ...] = ()) -> DataFrame:
    """``agreement`` for reports: an error that isn't finite is null, and so is ``all_close`` over no pairs."""
    found = agreement(actual, expected, keys, atol, rtol, by)
    for c in ("max_absolute_error", "max_relative_error"):
        found = found.withColumn(c, F.when(is_finite(F.col(c)), F.col(c)))
    return found


def agreement(actual: DataFrame, expected: DataFrame, keys: list[str], atol: float, rtol: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Largest absolute and relative error, and whether all pairs are finite and close."""
    both = actual.select(*keys, F.col("score").alias("a")).join(expected.select(*keys, F.col("score").alias("e")), keys)
    error = F.abs(F.col("a") - F.col("e"))
    columns = [
        F.count(F.lit(1)).alias("pairs"), max_abs(F.col("a") - F.col("e")).alias("max_absolute_error"), F.max(error / clamp_min(F.abs("e"), 1e-12)).alias("max_relative_error"),
        F.bool_and(is_finite(F.col("a")) & is_finite(F.col("e"))).alias("all_finite"), F.bool_and(error <= F.lit(atol) + F.lit(rtol) * F.abs("e")).alias("all_close"),
    ]
    return both.groupBy(*by).agg(*columns) if by else both.agg(*columns)


def length_summary(lengths: DataFrame, length: str, limit: int) -> DataFrame:
    """Count, extremes and percentiles of positive lengths, and how many exceed a limit."""
    n = F.col(length)
    over = F.count_if(n > limit)
    return lengths.where(n > 0).agg(
        F.count(F.lit(1)).alias("count"), F.min(n).alias("minimum"), F.percentile(n, F.lit(0.5)).alias("p50"), F.percentile(n, F.lit(0.95)).alias("p95"), F.max(n).alias("maximum"),
        over.alias("count_exceeding_limit"), (over / F.count(F.lit(1))).alias("fraction_exceeding_limit"),
    )
