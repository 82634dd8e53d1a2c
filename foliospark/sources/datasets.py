"""Retrieval datasets: manifests, a registry, and validated loading."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.text import is_blank
from foliospark.operators import validate
from foliospark.sources.config import record
from foliospark.sources.files import Artifact, pinned_url, scan, strict_json, verify

KEYS = {"name", "corpus", "queries", "qrels", "texts", "documents", "query_count"}


@dataclass(frozen=True)
class Manifest:
    """Where a dataset's four files are and how many rows they must have."""

    name: str
    corpus: str
    queries: str
    qrels: str
    texts: str
    documents: int
    query_count: int

    @classmethod
    def parse(cls, text: str) -> Manifest:
        """From JSON with exactly the keys of KEYS; counts must be integers."""
        value = strict_json(text, KEYS)
        for key in ("documents", "query_count"):
            if isinstance(value[key], bool) or not isinstance(value[key], int) or value[key] <= 0:
                raise validate.ContractError(f"{key} must be a positive integer")
        for key in KEYS - {"documents", "query_count"}:
            if not isinstance(value[key], str) or not value[key]:
                raise validate.ContractError(f"{key} must be a nonempty string")
        return cls(**value)


class Registry:
    """Manifests by name."""

    def __init__(self, *manifests: Manifest):
        self.manifests = {m.name: m for m in manifests}

    def __getitem__(self, name: str) -> Manifest:
        if name not in self.manifests:
            raise KeyError(f"unknown dataset {name!r}; known: {', '.join(sorted(self.manifests))}")
        return self.manifests[name]


@dataclass(frozen=True)
class Dataset:
    """documents (document_id, text), queries (query_id, text), qrels (query_id, document_id)."""

    documents: DataFrame
    queries: DataFrame
    qrels: DataFrame


def load(spark: SparkSession, manifest: Manifest, resolve: Callable[[str], str] = lambda p: p) -> Dataset:
    """A dataset after all its checks: counts, ids, keys, binary relevance, row order, guard and coverage.

    Row i of ``texts`` (query, text_description) belongs to row i of ``qrels``, which names row i of the
    corpus.  Image columns are never read.
    """
    corpus = scan(spark, resolve(manifest.corpus), ["corpus-id"])
    queries = scan(spark, resolve(manifest.queries), ["query-id", "query"])
    qrels = scan(spark, resolve(manifest.qrels), ["query-id", "corpus-id", "score"])
    texts = scan(spark, resolve(manifest.texts), ["query", "text_description"])
    for df, column in ((corpus, "corpus-id"), (queries, "query-id")):
        validate.as_id(df, column)
        validate.require_none(validate.duplicates(df, column), f"{column} repeats")
    check = validate.require_none
    check(validate.wrong_count(corpus, manifest.documents), "corpus rows")
    check(validate.wrong_count(queries, manifest.query_count), "query rows")
    check(validate.missing_text(queries, "query"), "queries without text")
    check(validate.missing_text(texts, "text_description", allow_empty=True), "null texts")
    check(validate.not_relevant(qrels), "judgements other than 1")
    check(validate.unknown_keys(qrels, "query-id", queries, "query-id"), "judgements of unknown queries")
    check(validate.unknown_keys(qrels, "corpus-id", corpus, "corpus-id"), "judgements of unknown pages")
    check(validate.unknown_keys(queries, "query-id", qrels, "query-id"), "queries without a positive")
    paths = {k: spark.read.parquet(resolve(getattr(manifest, k))) for k in ("qrels", "texts", "corpus")}
    check(validate.row_order_mismatches(paths["qrels"], "corpus-id", paths["corpus"], "corpus-id"), "row order of judgements and corpus")
    check(validate.guard_mismatches(paths["texts"], "query", paths["qrels"], "query-id", queries, "query-id", "query"), "texts beside other queries")
    pairs = validate.with_row_index(paths["texts"]).select("row_index", "text_description").join(validate.with_row_index(paths["qrels"]).select("row_index", "corpus-id"), "row_index")
    check(validate.conflicts(pairs, "corpus-id", "text_description"), "pages with several texts")
    documents = pairs.groupBy(F.col("`corpus-id`").cast("string").alias("document_id")).agg(F.first("text_description").alias("text"))
    check(validate.coverage_difference(documents, "document_id", corpus, "corpus-id"), "pages without text, or texts without page")
    return Dataset(
        documents,
        queries.select(F.col("`query-id`").cast("string").alias("query_id"), F.col("query").alias("text")),
        qrels.select(F.col("`query-id`").cast("string").alias("query_id"), F.col("`corpus-id`").cast("string").alias("document_id")).distinct(),
    )


def task_counts(dataset: Dataset) -> DataFrame:
    """One row: judgements and documents without any text."""
    judged = dataset.qrels.agg(F.count(F.lit(1)).alias("n")).scalar()
    return dataset.documents.agg(F.count(F.lit(1)).alias("documents"), F.count_if(is_blank(F.col("text")) | (F.col("text") == "")).alias("empty_documents")).withColumn("judgements", judged)


@dataclass(frozen=True)
class PinnedArtifact:
    """A file of a repository: a relative path within it, its size and its SHA-256."""

    path: str
    size: int
    sha256: str

    def __post_init__(self) -> None:
        parts = self.path.split("/")
        if not self.path or self.path.startswith("/") or "\\" in self.path or any(p in ("", ".", "..") for p in parts):
            raise validate.ContractError(f"{self.path!r} is no relative path within a repository")
        if self.size < 0 or not re.fullmatch(validate.DIGEST, self.sha256):
            raise validate.ContractError(f"{self.path}: a size can't be negative, and a digest is 64 hexadecimal digits")


@dataclass(frozen=True)
class PinnedManifest:
    """A dataset at a fixed revision of a repository: its four files with sizes and digests, and its row counts."""

    name: str
    repository: str
    revision: str
    corpus: PinnedArtifact
    queries: PinnedArtifact
    qrels: PinnedArtifact
    texts: PinnedArtifact
    documents: int
    query_count: int

    def __post_init__(self) -> None:
        for value, pattern, what in ((self.name, validate.IDENTIFIER, "name"), (self.repository, validate.REPOSITORY, "repository"), (self.revision, validate.REVISION, "revision")):
            if not re.fullmatch(pattern, value):
                raise validate.ContractError(f"{value!r} is no {what}")
        if self.documents <= 0 or self.query_count <= 0:
            raise validate.ContractError("row counts must be positive")
        if len({a.path for a in self.artifacts.values()}) < 4:
            raise validate.ContractError("a file is named twice")

    @classmethod
    def parse(cls, text: str) -> PinnedManifest:
        """From strict JSON with exactly these keys."""
        return record(cls, strict_json(text))

    @property
    def artifacts(self) -> dict[str, PinnedArtifact]:
        """The files by their part in the dataset."""
        return {part: getattr(self, part) for part in ("corpus", "queries", "qrels", "texts")}

    def urls(self, host: str) -> dict[str, str]:
        """Where the files lie at the revision."""
        return {part: pinned_url(host, self.repository, self.revision, a.path) for part, a in self.artifacts.items()}

    def manifest(self) -> Manifest:
        """The same without pins."""
        return Manifest(self.name, *(a.path for a in self.artifacts.values()), self.documents, self.query_count)


def load_pinned(spark: SparkSession, manifest: PinnedManifest, resolve: Callable[[str], str] = lambda p: p) -> Dataset:
    """``load`` after verifying sizes and digests of all files."""
    for a in manifest.artifacts.values():
        verify(spark, [Artifact(a.path, a.size, a.sha256)], resolve)
    return load(spark, manifest.manifest(), resolve)
