"""Content fingerprints: canonical JSON, digests of rows and of ordered relations."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical_json(value: object) -> bytes:
    """UTF-8 JSON with sorted keys, without blanks, letters unescaped, without NaN."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True, allow_nan=False).encode()


def canonical_digest(value: Mapping[str, object]) -> str:
    """SHA-256 of the canonical JSON."""
    return hashlib.sha256(canonical_json(value)).hexdigest()


def dataset_digest(documents: DataFrame, queries: DataFrame, qrels: DataFrame, tag: str) -> str:
    """SHA-256 of documents and queries in order of their ids: independent of row order.

    Rows are sorted by Spark and streamed to the driver one partition at a time, never held together.
    """
    digest = hashlib.sha256()

    def stream(rows: Iterable, name: str) -> None:
        digest.update(json.dumps(name).encode() + b":[")
        for i, row in enumerate(rows):
            digest.update(b"," * (i > 0) + canonical_json(row))
        digest.update(b"]")

    digest.update(b"{")
    stream(({"document_id": r[0], "text": r[1]} for r in documents.select("document_id", "text").orderBy("document_id").toLocalIterator()), "documents")
    digest.update(b',"format":' + canonical_json(tag) + b",")
    relevant = qrels.groupBy("query_id").agg(F.sort_array(F.collect_set("document_id")).alias("relevant"))
    ordered = queries.select("query_id", "text").join(relevant, "query_id", "left").orderBy("query_id")
    stream(({"query_id": r[0], "relevant_document_ids": r[2] or [], "text": r[1]} for r in ordered.toLocalIterator()), "queries")
    digest.update(b"}")
    return digest.hexdigest()


def row_digests(df: DataFrame, *columns: str) -> DataFrame:
    """A digest for each row: equal multisets of digests mean equal tables, whatever their order."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n")) for c in columns]
    return df.select(F.sha2(F.concat_ws("\0", *parts), 256).alias("digest"))


def score_matrix_digest(query_ids: list[str], document_ids: list[str], rows: Iterable[Iterable[float]], tag: str) -> str:
    """SHA-256 of a tag, the ids and the scores as float32, row by row."""
    digest = hashlib.sha256(tag.encode() + b"\0")
    for ids in (query_ids, document_ids):
        for i in ids:
            digest.update(i.encode() + b"\0")
        digest.update(b"\xff")
    for row in rows:
        values = list(row)
        digest.update(struct.pack(f"<{len(values)}f", *values))
    return digest.hexdigest()
