"""Synthetic token tables with masks, for benchmarks and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.vectors import normalized
from foliospark.operators.validate import ContractError


def token_table(spark: SparkSession, items: int, tokens: int, width: int, active: int, seed: int, item: str = "document_id", unit: bool = True) -> DataFrame:
    """``items`` times ``tokens`` seeded normal vectors, of length one if asked, the first ``active`` of each item unmasked."""
    if not 0 <= active <= tokens or min(items, tokens, width) < 1:
        raise ValueError("need positive sizes and 0 <= active <= tokens")
    rows = spark.range(items * tokens).select((F.col("id") / tokens).cast("bigint").cast("string").alias(item), (F.col("id") % tokens).cast("int").alias("pos"), F.col("id").alias("n"))
    emb = F.array(*[F.randn(seed + i) for i in range(width)])
    vectors = rows.select(item, "pos", (F.col("pos") < active).alias("mask"), emb.alias("emb"))
    emb = normalized(F.col("emb")) if unit else F.col("emb")
    return vectors.select(item, "pos", "mask", emb.cast("array<float>").alias("emb"))


def cyclic_length(number: Column, span: int, least: int = 2) -> Column:
    """Active tokens of item ``number``: ``least`` and more, in turn."""
    return F.lit(least) + number % F.lit(span)


def mask_from_integers(df: DataFrame, column: str) -> DataFrame:
    """A 0/1 column as booleans; any other value, or a null, is an error."""
    bad = df.where(~F.coalesce(F.col(column).isin(0, 1), F.lit(False))).take(1)
    if bad:
        raise ContractError(f"{column} holds {bad[0][column]!r}; masks are 0 or 1")
    return df.withColumn(column, F.col(column) == 1)


def named(requested: list[str] | None, configured: list[str], kind: str) -> list[str]:
    """The requested names in their order; repeated and unknown ones are errors, none means all."""
    if requested is None:
        return list(configured)
    if len(set(requested)) != len(requested):
        raise ValueError(f"a {kind} is repeated")
    unknown = [x for x in requested if x not in configured]
    if unknown:
        raise ValueError(f"unknown {kind}: {', '.join(unknown)}")
    return list(requested)
