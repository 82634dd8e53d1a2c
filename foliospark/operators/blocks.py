"""Scoring of a stated query set against all documents: queries in bounded blocks, the best k kept where they are found."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliospark.session import written_at

SCHEMA = "query_id string, document_id string, score double"
#: Cells of a score matrix that a task computes at once.
CELLS = 1 << 22


class Best:
    """The k best documents of each query that a task has met: higher score first, then the greater id.

    A document counts once, with its best score; scores that aren't finite don't count.  Such partial results
    merge: the best of all tasks' best are the best of all.
    """

    def __init__(self, k: int):
        self.k, self.held, self.size = k, [], 0

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of all queries (rows) for documents (columns)."""
        scores = np.where(np.isfinite(scores), scores, -np.inf)
        n = scores.shape[1]
        if n > self.k:
            scores = np.where(scores >= np.partition(scores, n - self.k, axis=1)[:, n - self.k, None], scores, -np.inf)
        rows, columns = np.nonzero(scores > -np.inf)
        self.held.append((rows, scores[rows, columns], ids[columns]))
        self.size += len(rows)
        if self.size > 4 * self.k * len(scores) + 100_000:
            self.compact()

    def compact(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, scores, ids = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object))
        places = np.unique(ids, return_inverse=True)[1] if len(ids) else np.zeros(0, np.int64)
        order = np.lexsort((-scores, places, rows))
        first = np.concatenate(([True], (rows[order][1:] != rows[order][:-1]) | (places[order][1:] != places[order][:-1])))[: len(order)]
        order = order[first]
        order = order[np.lexsort((-places[order], -scores[order], rows[order]))]
        starts = np.flatnonzero(np.diff(rows[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        kept = order[place < self.k]
        self.held, self.size = [(rows[kept], scores[kept], ids[kept])], len(kept)
        return self.held[0]


def scored(names: list[str], matrices: Iterable[tuple[np.ndarray, np.ndarray]], k: int | None, digits: int | None) -> Iterator[pa.RecordBatch]:
    """Batches of query, document and score from matrices (ids of documents, scores of all queries for them): all, or each query's best k."""
    labels, best = np.array(names, dtype=object), Best(k) if k else None
    columns = ["query_id", "document_id", "score"]
    for ids, scores in matrices:
        if digits is not None:
            scores = np.round(scores, digits)
        if best:
            best.offer(scores, ids)
        elif scores.size:
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(labels, len(ids)), pa.string()), pa.array(np.repeat(ids, len(labels)), pa.string()), pa.array(scores.T.reshape(-1))], columns)
    if best:
        rows, scores, ids = best.compact()
        for a in range(0, len(rows), 100_000):
            part = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(labels[rows[part]], pa.string()), pa.array(ids[part], pa.string()), pa.array(scores[part])], columns)


def blocks(rows: Iterable[tuple[str, np.ndarray]], bound: int) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Queries with their vectors in blocks of at most ``bound`` vectors, or one query."""
    block, size = [], 0
    for name, vectors in rows:
        if block and size + len(vectors) > bound:
            yield block
            block, size = [], 0
        block.append((name, vectors))
        size += len(vectors)
    yield block


def over_blocks(parts: Iterable[list], score: Callable[[list], DataFrame]) -> DataFrame:
    """The scores of all blocks.  The driver holds one or two blocks: where there are several, each one's scores are written to the shared folder before the next comes."""
    held, paths = None, []
    for block in parts:
        if held is not None:
            paths.append(written_at(score(held)))
        held = block
    last = score(held or [])
    if not paths:
        return last
    paths.append(written_at(last))
    return last.sparkSession.read.parquet(*paths)
