"""Dense chunk vectors: the best cosine of a page's chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.blocks import CELLS, SCHEMA, blocks, over_blocks, scored


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows; null ones are zero."""
    vectors = np.zeros((len(column), width))
    there = column.is_valid().to_numpy(zero_copy_only=False)
    vectors[there] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return vectors


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; zero ones stay zero."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def chunk_max(queries: list[tuple[str, list[float] | np.ndarray | None]], chunks: DataFrame, width: int, k: int | None = None, digits: int | None = None) -> DataFrame:
    """Page scores of a stated block of queries against all chunk vectors (document_id, emb): the largest cosine.

    Partial maxima are taken in each batch before the shuffle.  A query without a vector, or with a zero one,
    scores 0 everywhere; a chunk that is blank (null or zero vector) scores 0.  With ``k`` a task gives only its
    k best pages of each query, ties to the greater id; with ``digits`` scores are rounded before.
    """
    names = [q for q, _ in queries]
    matrix = unit(np.array([np.zeros(width) if v is None or not len(v) else np.asarray(v, np.float64).reshape(-1) for _, v in queries]).reshape(-1, width))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            step = max(1, CELLS // max(len(names), 1))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                pages, codes = np.unique(np.array(part.column(0).to_pylist(), dtype=object), return_inverse=True)
                order = np.argsort(codes, kind="stable")
                sims = matrix @ unit(rows_of(part.column(1), width)[order]).T
                yield pages, np.maximum.reduceat(sims, np.flatnonzero(np.diff(codes[order], prepend=-1)), axis=1)

    found = chunks.select("document_id", "emb").where("document_id is not null").mapInArrow(lambda batches: scored(names, matrices(batches), k, digits), SCHEMA)
    return found.groupBy("query_id", "document_id").agg(F.max("score").alias("score"))


def scores(queries: DataFrame, chunks: DataFrame, width: int, block: int = 4096, k: int | None = None, digits: int | None = None) -> DataFrame:
    """``chunk_max`` of a stated query set (query_id, emb), in blocks of a bounded number of queries, of which the driver holds one or two."""
    rows = queries.select("query_id", "emb").where("query_id is not null").orderBy("query_id").toLocalIterator()
    asked = ((r[0], np.zeros((1, width)) if r[1] is None else np.array(r[1], np.float64).reshape(1, width)) for r in rows)
    return over_blocks(blocks(asked, block), lambda part: chunk_max(part, chunks, width, k, digits))


def index_bytes(chunks: DataFrame, width: int) -> DataFrame:
    """One row: logical bytes of float32 vectors and the chunk-to-page map."""
    return chunks.agg((F.count(F.lit(1)) * (4 * width + 8)).alias("index_bytes"))
