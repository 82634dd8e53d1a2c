"""Encoded images as binary columns: format and size from the header, and a hook for decoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.fingerprints import canonical_digest
from foliospark.operators.subset import Selection, select_subsets
from foliospark.operators.validate import duplicates, require_none
from foliospark.session import bounded_rows, checkpointed

# Fixed value: the signature of a PNG file and the name of its first chunk, in hexadecimal.
PNG_HEAD = "89504E470D0A1A0A0000000D49484452"


def png_size(content: Column) -> Column:
    """struct(width, height) of a PNG, from its first 24 bytes; null for anything else or cut short."""
    head = F.hex(F.substring(content, 1, 24))
    number = lambda at: F.conv(F.substring(head, at, 8), 16, 10).cast("bigint")
    return F.when((F.length(head) == 48) & F.startswith(head, F.lit(PNG_HEAD)), F.struct(number(33).alias("width"), number(41).alias("height")))


def decode(df: DataFrame, key: str, content: str, decoder: Callable[[bytes], list[float]]) -> DataFrame:
    """Pixels of every image by a decoder of the caller's: key, pixels (null for null content)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [None if x is None else decoder(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.list_(pa.float32()))], [key, "pixels"])

    return df.select(F.col(f"`{key}`"), F.col(f"`{content}`")).mapInArrow(run, f"`{key}` {kind}, pixels array<float>")


@dataclass(frozen=True)
class ImageSubset:
    """Selected queries (task, query_id, hash) and pages (task, document_id, hash, positive, bytes, sha256, width, height), and the fingerprints of both."""

    queries: DataFrame
    pages: DataFrame
    selection_fingerprint: str
    content_fingerprint: str


def load_subset(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, selections: list[Selection], strict: bool = True) -> ImageSubset:
    """Pages of the stated subsets with their images: validated, selected, read and fingerprinted.

    ``corpus`` (task, document_id, bytes), ``queries`` (task, query_id), ``qrels`` (query_id, document_id).  Ids must not
    repeat, and a selected page needs an image whose header gives its size.  Only ids are shuffled for the
    selection; the bytes of the selected pages alone are joined to it.  The fingerprints are over the subset, whose
    size its specification bounds.
    """
    require_none(duplicates(corpus, "document_id"), "page ids repeat")
    require_none(duplicates(queries, "query_id"), "query ids repeat")
    chosen, selected = select_subsets(corpus.select("task", "document_id"), queries.select("task", "query_id"), qrels, selections, strict)
    selected = checkpointed(selected)
    content = corpus.select("task", "document_id", "bytes")
    size = png_size(F.col("bytes"))
    pages = checkpointed(selected.join(content, ["task", "document_id"]).select("*", F.sha2("bytes", 256).alias("sha256"), size["width"].alias("width"), size["height"].alias("height")))
    if strict:
        require_none(pages.where("width is null").select("document_id"), "selected pages without a readable image")
    most = sum(s.queries + s.documents for s in selections)
    asked = [list(r) for r in bounded_rows(chosen.select("task", "query_id", "hash").orderBy("task", "hash", "query_id"), most, "the subset of queries")]
    rows = bounded_rows(pages.select("task", "document_id", "hash", "positive", "sha256").orderBy("task", "hash", "document_id"), most, "the subset of pages")
    told = {"queries": asked, "pages": [list(r)[:4] for r in rows], "selections": [[s.task, s.salt, s.queries, s.documents] for s in selections]}
    return ImageSubset(chosen, pages, canonical_digest(told), canonical_digest({"images": [[r["task"], r["document_id"], r["sha256"]] for r in rows]}))
