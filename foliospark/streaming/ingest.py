"""Incremental upkeep of an index as documents arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.functions.text import tokenize_plain
from foliospark.operators import bm25


def term_counts(documents: DataFrame) -> DataFrame:
    """Occurrences of each term, for a batch of documents, or kept up to date for a stream of them (document_id, text)."""
    return documents.select(F.explode(tokenize_plain(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def ingest(spark: SparkSession, path: str, target: str, checkpoint: str, max_words: int = 256, overlap: int = 32, schema: str = "document_id string, text string") -> StreamingQuery:
    """Add the windows and postings of files new under ``path`` to the index at ``target``: what is there now, then stop.

    Each micro-batch is written once, under its number, so that a batch run again replaces itself.
    """
    arriving = spark.readStream.schema(schema).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        chunks = f"{target}/chunks/batch={number}"
        bm25.chunk_tokens(batch, max_words, overlap, plain=True).write.mode("overwrite").parquet(chunks)
        stored = batch.sparkSession.read.parquet(chunks)
        bm25.postings_of(stored).write.mode("overwrite").parquet(f"{target}/postings/batch={number}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def opened(spark: SparkSession, target: str, parameters: bm25.Parameters = bm25.Parameters()) -> bm25.Index:
    """The index that ``ingest`` keeps, as it stands now."""
    read = lambda what: spark.read.parquet(f"{target}/{what}").drop("batch")
    return bm25.index_of(read("chunks"), read("postings"), parameters, plain=True)
