"""BM25 over overlapping word windows, with the best window of a page as its score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from foliospark.functions.text import chunk_windows, tokenize, tokenize_plain
from foliospark.operators.blocks import CELLS, SCHEMA, over_blocks, scored
from foliospark.session import exists, spread, written


@dataclass(frozen=True)
class Parameters:
    """k1 > 0, 0 <= b <= 1, epsilon >= 0."""

    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25

    def __post_init__(self) -> None:
        for value in (self.k1, self.b, self.epsilon):
            if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or abs(value) == float("inf"):
                raise TypeError("parameters must be finite numbers")
        if self.k1 <= 0 or not 0 <= self.b <= 1 or self.epsilon < 0:
            raise ValueError("need k1 > 0, 0 <= b <= 1 and epsilon >= 0")


#: Columns of a window of the index.
CHUNK = ("document_id", "chunk", "length")


@dataclass(frozen=True)
class Index:
    """postings (term, document_id, chunk, tf and the chunk's length and its page's chunks), chunks (document_id, chunk, length), terms (term, df, idf), totals (n, average), windows (document_id, chunk, length and the tokens)."""

    postings: DataFrame
    chunks: DataFrame
    terms: DataFrame
    totals: DataFrame
    parameters: Parameters
    plain: bool
    windows: DataFrame

    def stands(self) -> bool:
        """Whether the written tables are still there."""
        return exists(self.terms.sparkSession, self.terms.inputFiles()[:1] + self.chunks.inputFiles()[:1])

    def tokens(self, text: Column) -> Column:
        """The index's tokenizer."""
        return tokenize_plain(text) if self.plain else tokenize(text)

    def bytes(self) -> DataFrame:
        """One row: logical bytes of terms, postings (``df`` of each term) and chunks."""
        parts = [self.terms.select((F.octet_length("term") + 8 + 16 * F.col("df")).alias("bytes")), self.chunks.select(F.lit(16).cast("bigint").alias("bytes"))]
        return parts[0].union(parts[1]).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("index_bytes"))


def build(documents: DataFrame, max_words: int = 256, overlap: int = 32, parameters: Parameters = Parameters(), plain: bool = False) -> Index:
    """The index of documents (document_id, text).

    A blank page is one chunk without terms; a null text has no chunk.  Windows come from the raw words and
    are tokenized afterwards; ``plain`` keeps tokenizing to built-in functions.  Tokens and terms are written once
    to the shared folder, as an index is, and everything else is read from them; postings are only made where they are
    asked for.  Inverse frequencies are over chunks, and a negative one is replaced by ``epsilon`` times the mean of all.
    """
    base = written(chunk_tokens(documents, max_words, overlap, plain))
    return index_of(base, postings_of(base), parameters, plain)


def chunk_tokens(documents: DataFrame, max_words: int, overlap: int, plain: bool) -> DataFrame:
    """The windows of documents with their tokens: document_id, chunk, chunks, length, tokens."""
    windows = chunk_windows(spread(documents.select("document_id", "text")), "text", max_words, overlap, chunks="chunks")
    joined = F.array_join("words", " ")
    tokens = windows.select("document_id", "chunk", "chunks", (tokenize_plain(joined) if plain else tokenize(joined)).alias("tokens"))
    return tokens.select("document_id", "chunk", "chunks", F.size("tokens").alias("length"), "tokens")


def postings_of(tokens: DataFrame) -> DataFrame:
    """How often each term stands in each window, with the window's length and the number of its page's windows."""
    keys = ["term", "document_id", "chunk", "chunks", "length"]
    return tokens.select(F.explode("tokens").alias("term"), *keys[1:]).groupBy(*keys).agg(F.count(F.lit(1)).alias("tf"))


def index_of(windows: DataFrame, postings: DataFrame, parameters: Parameters = Parameters(), plain: bool = False) -> Index:
    """An index over stored windows (``chunk_tokens``) and their postings; the windows' terms are counted and written now."""
    chunks = windows.select(*CHUNK)
    totals = chunks.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"))
    df = windows.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = totals.select("n").scalar()
    raw = df.select("term", "df", (F.log(size - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean")).scalar()
    terms = raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(parameters.epsilon) * mean).otherwise(F.col("raw")).alias("idf"))
    return Index(postings, chunks, written(terms), totals, parameters, plain, windows.select(*CHUNK, "tokens"))


#: Pairs of a query and a term in a block whose scores all come out.
BLOCK_PAIRS = 65_536
#: Windows, and pairs of a window and a query, that a task is meant to have, and the pieces that are made for that at most.
TASK_WINDOWS, TASK_CELLS, PIECES = 1 << 15, 1 << 24, 4_096


@dataclass(frozen=True)
class Asked:
    """A block of queries by term: the queries ``columns[starts[t]:starts[t + 1]]`` hold the term ``terms[t]`` with these weights."""

    names: pa.Array
    terms: pa.Array
    starts: np.ndarray
    columns: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(block: list[tuple[object, list[tuple[str, float]]]], kind: pa.DataType) -> Asked:
        terms = sorted({t for _, own in block for t, _ in own})
        place = {t: i for i, t in enumerate(terms)}
        codes = np.array([place[t] for _, own in block for t, _ in own], np.int64)
        columns = np.repeat(np.arange(len(block)), [len(own) for _, own in block])
        weights = np.array([w for _, own in block for _, w in own], np.float64)
        order = np.lexsort((columns, codes))
        return Asked(pa.array([q for q, _ in block], kind), pa.array(terms, pa.string()), np.searchsorted(codes[order], np.arange(len(terms) + 1)), columns[order], weights[order])


def scores(index: Index, queries: DataFrame, digits: int | None = None, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Non-zero page scores of queries (query_id, text): query_id, document_id, score.

    Only windows that hold a term of a query are scored for it; a term that a query repeats counts each time.  A
    page's score is its best chunk's, and 0 where another chunk of the page lacks every term and the matching ones
    score below 0.  Pages that don't come out score 0.  With ``digits`` scores are rounded.

    There may be nearly as many scores as pairs of a query and a page, so they leave the task that makes them and are
    neither shuffled nor written: the windows are shuffled once, by page, and each block of queries, of at most
    ``block_pairs`` pairs of a query and a term or one query, meets them there.  The driver holds all blocks.
    """
    p, totals = index.parameters, index.totals.first()
    words = queries.where("query_id is not null and text is not null").select("query_id", F.explode(index.tokens(F.col("text"))).alias("term"))
    asked = words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")).join(index.terms.select("term", "idf"), "term")
    each = asked.groupBy("query_id").agg(F.collect_list(F.struct("term", (F.col("times") * F.col("idf")).alias("weight"))).alias("terms"))
    kinds = [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("document_id", index.windows.schema["document_id"].dataType), T.StructField("score", T.DoubleType())]
    named, block, size, parts = to_arrow_type(kinds[0].dataType), [], 0, []
    for row in each.orderBy("query_id").toLocalIterator():
        if block and size + len(row["terms"]) > block_pairs:
            parts.append(Asked.of(block, named))
            block, size = [], 0
        block.append((row["query_id"], [(t["term"], t["weight"]) for t in row["terms"]]))
        size += len(row["terms"])
    parts.append(Asked.of(block, named))
    cells = totals["n"] * sum(len(part.names) for part in parts)
    pieces = max(index.windows.sparkSession.sparkContext.defaultParallelism, min(PIECES, max(totals["n"] // TASK_WINDOWS, cells // TASK_CELLS)))
    # Tokens hold no space.  In one string they take less room than one by one.
    windows = index.windows.select("document_id", "length", F.array_join("tokens", " ").alias("text"))
    pages = windows.repartition(pieces, "document_id").sortWithinPartitions("document_id")
    average = totals["average"] or 1.0
    found = [pages.mapInArrow(lambda batches, part=part: page_scores(batches, part, p, average, digits), T.StructType(kinds)) for part in parts]
    return reduce(DataFrame.union, found)


def page_scores(batches: Iterator[pa.RecordBatch], asked: Asked, p: Parameters, average: float, digits: int | None) -> Iterator[pa.RecordBatch]:
    """The scores of a block of queries for windows (document_id, length, tokens in a string) that come page by page."""
    wide, counts = len(asked.names), np.diff(asked.starts)
    step = max(1, CELLS // max(wide, len(asked.columns), 1))
    above = bool((asked.weights > 0).all())

    def out(ids: pa.Array, best: np.ndarray, hit: np.ndarray) -> Iterator[pa.RecordBatch]:
        pages, columns = np.nonzero(hit)
        values = best[pages, columns]
        if digits is not None:
            values = np.round(values, digits)
        for a in range(0, len(values), 100_000):
            part = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([asked.names.take(pa.array(columns[part])), ids.take(pa.array(pages[part])), pa.array(values[part])], ["query_id", "document_id", "score"])

    held: tuple[pa.Array, np.ndarray, np.ndarray] | None = None  # the last page, of which more windows may come
    for batch in batches if wide else ():
        tokens = pc.split_pattern(batch.column(2), " ")
        codes = pc.index_in(tokens.flatten(), asked.terms)
        there = codes.is_valid().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(tokens.offsets.to_numpy()))[there]
        keys, tf = np.unique(owner * len(asked.terms) + codes.drop_null().to_numpy(zero_copy_only=False), return_counts=True)
        owner, code = np.divmod(keys, max(1, len(asked.terms)))
        length = batch.column(1).to_numpy(zero_copy_only=False)[owner]
        part = tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * length / average))
        named = batch.column(0).dictionary_encode(null_encoding="encode")
        page = named.indices.to_numpy(zero_copy_only=False)
        for a in range(0, batch.num_rows, step):
            rows = min(step, batch.num_rows - a)
            own = slice(*np.searchsorted(owner, (a, a + rows)))
            # Each term of a window adds to the cells of the queries that hold it.
            n = counts[code[own]]
            at = np.arange(n.sum()) + np.repeat(asked.starts[code[own]] - (np.cumsum(n) - n), n)
            cells = np.repeat((owner[own] - a) * wide, n) + asked.columns[at]
            sums = np.bincount(cells, np.repeat(part[own], n) * asked.weights[at], minlength=rows * wide).astype(np.float64, copy=False).reshape(rows, wide)  # of nothing it makes integers
            hits = sums > 0 if above else (np.bincount(cells, minlength=rows * wide) > 0).reshape(rows, wide)
            first = np.flatnonzero(np.diff(page[a : a + rows], prepend=-1))
            best, hit, ids = np.maximum.reduceat(sums, first), np.logical_or.reduceat(hits, first), named.dictionary.take(pa.array(page[a : a + rows][first]))
            if held and held[0][0].as_py() == ids[0].as_py():
                best[0], hit[0] = np.maximum(best[0], held[1][0]), hit[0] | held[2][0]
            elif held:
                yield from out(*held)
            yield from out(ids[:-1], best[:-1], hit[:-1])
            held = ids[-1:], best[-1:].copy(), hit[-1:].copy()
    if held:
        yield from out(*held)


#: Terms of a block of queries.
BLOCK_TERMS = 2_048


def top_k(index: Index, queries: DataFrame, k: int, digits: int | None = None, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The best k pages of each stated query, pages without a match included: query_id, document_id, score.

    Every page with a window has a score, its best window's, 0 where no term matches; ties go to the greater id.
    Queries travel in blocks of at most ``block_terms`` terms (or one query); windows stay where they are, and
    a batch of them is scored by one product of its term weights with the queries' inverse frequencies.  A
    task gives only its best k of each query.  With ``digits`` scores are rounded before they are compared.
    Null ids and null queries are left out; a query without known terms has the k greatest ids.
    """
    p, totals = index.parameters, index.totals.first()
    words = queries.where("query_id is not null and text is not null").select("query_id", F.explode_outer(index.tokens(F.col("text"))).alias("term"))
    asked = words.groupBy("query_id", "term").agg(F.count("term").alias("times")).join(index.terms.select("term", "idf"), "term", "left")
    each = asked.groupBy("query_id").agg(F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", (F.col("times") * F.col("idf")).alias("weight")))).alias("terms"))

    def blocks() -> Iterator[list]:
        block, size = [], 0
        for row in each.orderBy("query_id").toLocalIterator():
            if block and size + len(row["terms"]) > block_terms:
                yield block
                block, size = [], 0
            block.append((row["query_id"], [(t["term"], t["weight"]) for t in row["terms"]]))
            size += len(row["terms"])
        yield block

    def score(block: list) -> DataFrame:
        names = [q for q, _ in block]
        terms = sorted({t for _, own in block for t, _ in own})
        place = {t: i for i, t in enumerate(terms)}
        weights = np.zeros((len(names), len(terms)))
        for i, (_, own) in enumerate(block):
            for t, w in own:
                weights[i, place[t]] += w
        average = totals["average"] or 1.0

        def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            known = pa.array(terms, pa.string())
            step = max(1, CELLS // max(len(terms), len(names), 1))
            for batch in batches:
                for a in range(0, batch.num_rows, step):
                    part = batch.slice(a, step)
                    lists = part.column(2)
                    counts = np.diff(lists.offsets.to_numpy())
                    codes = pc.index_in(lists.flatten(), known)
                    owner = np.repeat(np.arange(part.num_rows), counts)
                    there = codes.is_valid().to_numpy(zero_copy_only=False)
                    cells = owner[there] * len(terms) + codes.drop_null().to_numpy(zero_copy_only=False)
                    tf = np.bincount(cells, minlength=part.num_rows * len(terms)).reshape(part.num_rows, len(terms)).astype(np.float64)
                    length = part.column(1).to_numpy(zero_copy_only=False)[:, None]
                    found = np.divide(tf * (p.k1 + 1), tf + p.k1 * (1 - p.b + p.b * length / average), out=np.zeros_like(tf), where=tf > 0) @ weights.T
                    pages, at = np.unique(np.array(part.column(0).to_pylist(), dtype=object), return_inverse=True)
                    order = np.argsort(at, kind="stable")
                    best = np.maximum.reduceat(found[order], np.flatnonzero(np.diff(at[order], prepend=-1)), axis=0)
                    yield pages, best.T

        rows = index.windows.where("document_id is not null").select("document_id", "length", "tokens")
        return rows.mapInArrow(lambda batches: scored(names, matrices(batches), k, digits), SCHEMA)

    found = over_blocks(blocks(), score)
    return found.groupBy("query_id", "document_id").agg(F.max("score").alias("score"))
