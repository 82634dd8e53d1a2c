"""Masked late interaction: for each query token the best document token, summed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.blocks import CELLS, SCHEMA, blocks, over_blocks, scored

#: Query tokens that a task holds at once: with their width this bounds what is broadcast.
BLOCK_TOKENS = 16_384


def active(tokens: DataFrame, mask: str = "mask") -> DataFrame:
    """Tokens whose mask isn't false; a null mask is true."""
    return tokens.where(F.coalesce(F.col(mask), F.lit(True)))


def prefix_mask(pos: str, valid: int | str):
    """True for the first ``valid`` positions."""
    return F.col(pos) < (F.lit(valid) if isinstance(valid, int) else F.col(valid))


def packed(tokens: DataFrame, item: str) -> DataFrame:
    """One row an item: its active vectors in order of position; a repeated position counts once, with its greatest active vector."""
    once = tokens.groupBy(item, "pos").agg(F.max(F.struct(F.coalesce("mask", F.lit(True)).alias("mask"), "emb")).alias("best")).select(item, "pos", "best.mask", "best.emb")
    rows = F.sort_array(F.collect_list(F.when(F.col("mask"), F.struct("pos", "emb"))))
    return once.groupBy(item).agg(F.transform(rows, lambda x: x["emb"]).alias("vectors"))


def best_of_tokens(queries: np.ndarray, vectors: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each query token (row) and document with vectors (column) the largest dot product, in steps of bounded size."""
    best = np.full((len(queries), len(counts)), -np.inf)
    owners = np.repeat(np.arange(len(counts)), counts)
    step = max(1, CELLS // max(len(queries), 1))
    for a in range(0, len(vectors), step):
        own = owners[a : a + step]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        found = np.maximum.reduceat(queries @ vectors[a : a + step].T, starts, axis=1)
        best[:, own[starts]] = np.maximum(best[:, own[starts]], found)
    return best


def _score(block: list[tuple[str, np.ndarray]], width: int, k: int | None, digits: int | None):
    names = [n for n, _ in block]
    sizes = np.array([len(v) for _, v in block], np.int64)
    stacked = np.concatenate([v for _, v in block]) if block else np.zeros((0, width))
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.array(batch.column(0).to_pylist(), dtype=object)
            counts = np.diff(batch.column(1).offsets.to_numpy())
            vectors = batch.column(1).flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            ends = np.cumsum(counts)
            step = max(1, CELLS // max(len(stacked), 1))
            for a in range(0, len(ids), step):
                own = counts[a : a + step]
                scores = np.where((sizes > 0)[:, None], -np.inf, 0.0) * np.ones(len(own))
                full = np.flatnonzero(own)
                if len(full) and len(some):
                    best = best_of_tokens(stacked, vectors[ends[a] - counts[a] : ends[a : a + step][-1]], own[full])
                    scores[np.ix_(some, full)] = np.add.reduceat(best, starts, axis=0)
                yield ids[a : a + step], scores

    return lambda batches: scored(names, matrices(batches), k, digits)


def maxsim(queries: DataFrame, documents: DataFrame, width: int, block_tokens: int = BLOCK_TOKENS, k: int | None = None, digits: int | None = None) -> DataFrame:
    """query_id, document_id, score: the stated queries, in blocks, against all documents by matrix products.

    Tokens have an id, ``pos``, ``mask`` and ``emb``; padding may be anywhere.  A query without active tokens
    scores 0; else a document without any scores -inf.  NaN in an active vector goes through, masked vectors
    don't count.  Documents stay where they are, one row each; a block of at most ``block_tokens`` query tokens (or one
    query) travels to every task, so what a task or the driver holds doesn't grow with either side.

    With ``k`` a task gives only its k best finite scores of each query, ties to the greater id; the k best of
    what comes out are the k best of all.  With ``digits`` scores are rounded before they are compared.
    """
    items = packed(documents, "document_id").where("document_id is not null")
    rows = packed(queries, "query_id").where("query_id is not null").orderBy("query_id").toLocalIterator()
    asked = ((r["query_id"], np.array(r["vectors"], dtype=np.float64).reshape(-1, width)) for r in rows)
    return over_blocks(blocks(asked, block_tokens), lambda block: items.mapInArrow(_score(block, width, k, digits), SCHEMA))
