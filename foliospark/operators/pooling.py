"""Masked mean pooling to single vectors; their scores are those of ``dense``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.numeric import is_finite
from foliospark.functions.vectors import normalized


def mean_pool(tokens: DataFrame, item: str = "document_id", width: int = 128) -> DataFrame:
    """The unit mean of each item's active vectors: item, vector.

    A position that occurs more than once counts once, with its greatest active vector; one of another length doesn't count.  Vectors are summed in Arrow batches where they lie
    after that, and the sums of an item's parts are added up, so an item of any number of vectors is spread over
    all tasks.  An item whose mean is zero or not finite has no direction and is left out; see
    ``without_direction``.
    """
    return _means(tokens, item, width).where(is_finite(F.col("length")) & (F.col("length") > 0)).select(item, normalized(F.col("mean")).alias("vector"))


def without_direction(tokens: DataFrame, item: str = "document_id", width: int = 128) -> DataFrame:
    """Items whose mean vector is zero or not finite."""
    return _means(tokens, item, width).where(~(is_finite(F.col("length")) & (F.col("length") > 0))).select(item)


def _sums(width: int, weighted: bool):
    """Sums of the vectors of each item in a batch; with ``weighted`` the batch has numbers of vectors, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            items = batch.column(0).dictionary_encode()
            codes = items.indices.to_numpy(zero_copy_only=False)
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            sums = np.add.reduceat(vectors[order], starts, axis=0)
            each = batch.column(2).to_numpy(zero_copy_only=False)[order] if weighted else np.ones(len(order), np.int64)
            offsets = pa.array(np.arange(len(starts) + 1, dtype=np.int32) * width)
            lists = pa.ListArray.from_arrays(offsets, pa.array(sums.reshape(-1)))
            yield pa.RecordBatch.from_arrays([items.dictionary.take(pa.array(codes[order][starts])), lists, pa.array(np.add.reduceat(each, starts))], ["item", "total", "n"])

    return run


def _means(tokens: DataFrame, item: str, width: int) -> DataFrame:
    mask = F.coalesce("mask", F.lit(True))
    once = tokens.where(F.col(item).isNotNull()).groupBy(item, "pos").agg(F.max(F.struct(mask.alias("mask"), "emb")).alias("best")).where("best.mask")
    rows = once.select(F.col(item).cast("string").alias("item"), F.col("best.emb").alias("emb")).where(F.size("emb") == width)
    schema = "item string, total array<double>, n bigint"
    parts = rows.mapInArrow(_sums(width, False), schema).repartition("item").sortWithinPartitions("item").mapInArrow(_sums(width, True), schema)
    # An item whose rows end one batch and begin the next has two sums left; these are few.
    total = F.aggregate(F.collect_list("total"), F.array_repeat(F.lit(0.0), width), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    means = parts.groupBy("item").agg(total.alias("total"), F.sum("n").alias("n")).select(F.col("item").alias(item), F.transform("total", lambda x: x / F.col("n")).alias("mean"))
    return means.withColumn("length", F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x)))
