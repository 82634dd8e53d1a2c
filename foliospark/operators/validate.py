"""Integrity contracts: each check is a DataFrame of the rows that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.numeric import is_finite
from foliospark.functions.vectors import finite

# Patterns of revisions, digests, repository names and identifiers.
REVISION, DIGEST, REPOSITORY, IDENTIFIER = r"^[0-9a-f]{40}$", r"^[0-9a-f]{64}$", r"^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+$", r"^[a-z0-9][a-z0-9._-]*$"


class ContractError(ValueError):
    """Data breaks a contract."""


def require_none(violations: DataFrame, what: str) -> None:
    """Raise, showing a few rows, if there are violations."""
    rows = violations.take(5)
    if rows:
        raise ContractError(f"{what}: {rows}")


def as_id(df: DataFrame, column: str) -> Column:
    """An id as a string; only integers and strings are ids."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.IntegralType, T.StringType)):
        raise ContractError(f"{column} is {kind.simpleString()}; ids are integers or strings")
    return F.col(f"`{column}`").cast("string")


def missing_text(df: DataFrame, column: str, allow_empty: bool = False) -> DataFrame:
    """Rows whose text is null or, unless allowed, empty."""
    value = F.col(f"`{column}`")
    return df.where(value.isNull() if allow_empty else value.isNull() | (value == ""))


def wrong_count(df: DataFrame, expected: int) -> DataFrame:
    """One row if the table hasn't the expected number of rows."""
    return df.agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") != expected)


def duplicates(df: DataFrame, *columns: str) -> DataFrame:
    """Keys that occur more than once after being made strings."""
    keys = [F.col(f"`{c}`").cast("string").alias(c) for c in columns]
    return df.select(*keys).groupBy(*[f"`{c}`" for c in columns]).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def not_relevant(qrels: DataFrame, score: str = "score") -> DataFrame:
    """Judgements that aren't exactly 1; booleans and strings never are."""
    if not isinstance(qrels.schema[score].dataType, T.NumericType):
        return qrels
    value = F.col(f"`{score}`").cast("double")
    return qrels.where(~F.coalesce(is_finite(value) & (value == 1.0), F.lit(False)))


def relevant(qrels: DataFrame, score: str = "score") -> DataFrame:
    """Judgements that are exactly 1; a null, a boolean or a string never is."""
    if not isinstance(qrels.schema[score].dataType, T.NumericType):
        return qrels.where("false")
    return qrels.where(F.col(f"`{score}`").cast("double") == 1.0)


def unknown_keys(df: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table lacks (a foreign-key check)."""
    keys = known.select(F.col(f"`{key}`").cast("string").alias("known_")).distinct()
    return df.withColumn("key_", F.col(f"`{column}`").cast("string")).join(keys, F.col("key_") == F.col("known_"), "left_anti").drop("key_")


def coverage_difference(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Ids on one side only: id, side."""
    a = left.select(F.col(f"`{left_key}`").cast("string").alias("id")).distinct()
    b = right.select(F.col(f"`{right_key}`").cast("string").alias("id")).distinct()
    return a.join(b, "id", "left_anti").withColumn("side", F.lit("left")).union(b.join(a, "id", "left_anti").withColumn("side", F.lit("right")))


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with several different values; nulls don't count."""
    return df.groupBy(F.col(f"`{key}`").alias(key)).agg(F.count_distinct(F.col(f"`{value}`")).alias("values")).where(F.col("values") > 1)


def with_row_index(df: DataFrame) -> DataFrame:
    """The rows of a scanned Parquet table with their place in it.

    The reader reports a row's place in its file.  Where the table has several files, they follow each other in
    order of their paths, and each begins where the ones before end; the table of beginnings has a row for each
    file, as Spark's own file listing has on the driver.
    """
    if len(df.inputFiles()) < 2:
        return df.withColumn("row_index", F.col("_metadata.row_index"))
    sizes = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n")).orderBy("file").collect()
    starts, start = [], 0
    for file, n in sizes:
        starts.append((file, start))
        start += n
    starts = df.sparkSession.createDataFrame(starts, "file_ string, start_ bigint")
    placed = df.withColumn("file_", F.col("_metadata.file_path")).withColumn("row_index", F.col("_metadata.row_index"))
    return placed.join(F.broadcast(starts), "file_").withColumn("row_index", F.col("row_index") + F.col("start_")).drop("file_", "start_")


def row_order_mismatches(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Positional join of two single-file tables: places whose keys differ, or that one side lacks."""
    a = with_row_index(left).select("row_index", F.col(f"`{left_key}`").cast("string").alias("left_id"))
    b = with_row_index(right).select("row_index", F.col(f"`{right_key}`").cast("string").alias("right_id"))
    return a.join(b, "row_index", "full").where(~F.col("left_id").eqNullSafe(F.col("right_id")))


def guard_mismatches(left: DataFrame, guard: str, right: DataFrame, key: str, texts: DataFrame, text_key: str, text: str) -> DataFrame:
    """Positional join with a guard: places where ``guard`` differs from the text that the other side's key names."""
    a = with_row_index(left).select("row_index", F.col(f"`{guard}`").alias("found"))
    b = with_row_index(right).select("row_index", F.col(f"`{key}`").cast("string").alias("id"))
    named = texts.select(F.col(f"`{text_key}`").cast("string").alias("id"), F.col(f"`{text}`").alias("expected"))
    return a.join(b.join(named, "id", "left"), "row_index", "full").where(~F.col("found").eqNullSafe(F.col("expected")))


def digest_mismatches(files: DataFrame, content: Column, expected: Column, key: str) -> DataFrame:
    """Rows whose content's SHA-256 isn't the expected one: key, found, expected."""
    found = F.when(content.isNotNull(), F.sha2(content, 256))
    return files.select(F.col(f"`{key}`").alias(key), found.alias("found"), expected.alias("expected")).where(~F.col("found").eqNullSafe(F.col("expected")))


def token_violations(tokens: DataFrame, item: str, tolerance: float | None = None) -> DataFrame:
    """Items whose tokens break the encoding contract: no active token, active values that aren't finite, masked ones that aren't 0."""
    mask = F.coalesce("mask", F.lit(True))
    emb = F.coalesce("emb", F.array().cast("array<float>"))
    rows = tokens.groupBy(item).agg(
        F.count_if(mask).alias("active"),
        F.count_if(mask & ~finite(emb)).alias("not_finite"),
        F.count_if(~mask & F.exists(emb, lambda x: F.isnan(x) | (x != 0))).alias("masked_not_zero"),
    )
    return rows.where("active = 0 or not_finite > 0 or masked_not_zero > 0")


def not_right_padded(tokens: DataFrame, item: str) -> DataFrame:
    """Items with an active token behind a masked one."""
    mask = F.coalesce("mask", F.lit(True))
    ends = tokens.groupBy(item).agg(F.max(F.when(mask, F.col("pos"))).alias("last_active"), F.min(F.when(~mask, F.col("pos"))).alias("first_masked"))
    return ends.where("last_active > first_masked")
