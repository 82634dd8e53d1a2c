"""Top N items within every group by a mergeable, bounded aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.session import bounded_rows

#: Rows a task gathers before it compacts them to at most N for each group.
BUFFER_ROWS = 250_000
#: Compacted rows above which a task hands its heaps on and starts anew; the merge makes up for it.
STATE_ROWS = 500_000


def compact(rows: pa.Table, groups: list[str], item: str, score: str, limit: str) -> pa.Table:
    """At most N rows a group: each item once with its best score, best first, ties to the greater item."""
    keys = groups + [item]
    best = rows.group_by(keys, use_threads=False).aggregate([(score, "max"), (limit, "max")])
    best = best.rename_columns([*keys, score, limit] if best.column_names[0] == keys[0] else [score, limit, *keys])
    order = [(g, "ascending") for g in groups] + [(score, "descending"), (item, "descending")]
    best = best.sort_by(order).combine_chunks()
    n = best.num_rows
    if n == 0:
        return best
    import numpy as np

    new = np.zeros(n, dtype=bool)
    new[0] = True
    for g in groups:
        codes = best[g].combine_chunks()
        codes = codes.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    return best.filter(pa.array(place < best[limit].to_numpy()))


def _heaps(groups: list[str], item: str, score: str, limit: str, schema: pa.Schema, buffer_rows: int, state_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = kept = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(pa.Table.from_batches([batch]).cast(schema))
            size += batch.num_rows
            if size - kept >= buffer_rows:
                state = compact(pa.concat_tables(held), groups, item, score, limit).select(schema.names)
                if state.num_rows >= state_rows:
                    yield from state.to_batches(max_chunksize=10_000)
                    held, size, kept = [], 0, 0
                else:
                    held, size, kept = [state], state.num_rows, state.num_rows
        if held:
            state = compact(pa.concat_tables(held), groups, item, score, limit).select(schema.names)
            yield from state.to_batches(max_chunksize=10_000)

    return run


def top_n(
    df: DataFrame,
    groups: list[str],
    item: str,
    score: str,
    limit: str,
    place: str = "place",
    buffer_rows: int = BUFFER_ROWS,
    state_rows: int = STATE_ROWS,
) -> DataFrame:
    """The best ``limit`` items of every group, as ``groups``, ``place`` (from 1), ``item`` and ``score``.

    ``limit`` is an integer column that is constant within a group.  Before the shuffle each task keeps,
    for every group it meets, a bounded heap of the best N items and folds incoming batches into it; after
    the shuffle the heaps of a group are merged.  A group therefore sends at most N rows per task, however
    many rows it has.  A task that meets very many groups hands its heaps on when they reach
    ``state_rows`` rows and starts new ones, so its memory is bounded too.

    Ordering is by score, highest first, then by ``item``, greatest code points first; an item counts once
    in its group, with its best score.  Rows whose score is null, NaN or infinite, and rows without an
    item, don't count.  A null in a grouping column is a value of its own.  Groups whose limit is null or
    below 1 give nothing.  Other columns are dropped.  An empty table gives an empty result.
    """
    names = [f"g{i}" for i in range(len(groups))] + ["item", "score", "limit"]
    narrow = df.select(
        *[F.col(f"`{g}`").cast("string").alias(f"g{i}") for i, g in enumerate(groups)],
        F.col(f"`{item}`").cast("string").alias("item"),
        (F.col(f"`{score}`").cast("double") + F.lit(0.0)).alias("score"),
        F.col(f"`{limit}`").cast("int").alias("limit"),
    ).where(
        F.col("item").isNotNull()
        & F.col("score").isNotNull()
        & ~F.isnan("score")
        & (F.abs("score") != float("inf"))
        & (F.col("limit") >= 1)
    )
    fields = [T.StructField(c, T.StringType()) for c in names[:-2]] + [T.StructField("score", T.DoubleType()), T.StructField("limit", T.IntegerType())]
    arrow = pa.schema([(c, pa.string()) for c in names[:-2]] + [("score", pa.float64()), ("limit", pa.int32())])
    keys = names[: len(groups)]
    heaps = narrow.mapInArrow(_heaps(keys, "item", "score", "limit", arrow, buffer_rows, state_rows), T.StructType(fields))
    # One shuffle on the group serves the merge of repeated items and the final order alike.
    merged = heaps.repartition(*keys).groupBy(*keys, "item").agg(F.max("score").alias("score"), F.max("limit").alias("limit"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("item"))
    ranked = merged.withColumn("place_", F.row_number().over(order)).where("place_ <= limit")
    return ranked.select(
        *[F.col(k).alias(g) for k, g in zip(keys, groups)],
        F.col("place_").cast("int").alias(place),
        F.col("item").alias(item),
        F.col("score").alias(score),
    )


def with_limits(scores: DataFrame, scorers: DataFrame, key: str = "scorer", limit: str = "k") -> DataFrame:
    """``scores`` with the limit of its scorer; rows of scorers that the parameter table lacks are left out.

    The parameter table is bounded by contract and its size is checked before it is broadcast.  A scorer
    listed twice takes its largest limit.
    """
    rows = bounded_rows(scorers.select(key, limit).where(F.col(key).isNotNull() & F.col(limit).isNotNull()), 10_000, "the scorer table")
    best: dict[str, int] = {}
    for r in rows:
        best[r[0]] = max(best.get(r[0], 0), int(r[1]))
    small = scores.sparkSession.createDataFrame(sorted(best.items()), f"`{key}` string, limit_of_scorer int")
    return scores.join(F.broadcast(small), key)
