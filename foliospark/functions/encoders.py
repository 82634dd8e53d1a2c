"""Text encoders: a deterministic one by hashing, as a stand-in for a trained model."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliospark.functions.text import tokens_of


@dataclass(frozen=True)
class HashingEncoder:
    """Every token adds 1 or -1 to one of ``width`` places, by a hash of seed and token; vectors have length one.

    A text without tokens is a zero vector, a null text a null.
    """

    width: int = 256
    seed: int = 0

    def encode(self, texts: DataFrame) -> DataFrame:
        """``texts`` with ``emb``, the vector of ``text``; a column of that name is replaced."""
        columns = [c for c in texts.columns if c != "emb"]
        at, width, start = columns.index("text"), self.width, zlib.crc32(str(self.seed).encode())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, int] = {}
            for batch in batches:
                vectors = np.zeros((batch.num_rows, width), np.float32)
                for i, text in enumerate(batch.column(at).to_pylist()):
                    for token in tokens_of(text) if text else ():
                        h = known.get(token)
                        if h is None:
                            h = known[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"), start)
                        vectors[i, (h >> 1) % width] += 1.0 if h & 1 else -1.0
                    if len(known) > 500_000:
                        known.clear()
                length = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = np.divide(vectors, length, out=vectors, where=length > 0)
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width)
                emb = pa.ListArray.from_arrays(offsets, pa.array(vectors.reshape(-1)), mask=batch.column(at).is_null())
                yield pa.RecordBatch.from_arrays([*batch.columns, emb], [*columns, "emb"])

        rows = texts.select(*[f"`{c}`" for c in columns])
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(run, f"{schema}, emb array<float>")
