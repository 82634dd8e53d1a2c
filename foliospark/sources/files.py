"""Scans of Parquet and binary files, verified artifacts, strict JSON, atomic reports."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.validate import ContractError, require_none

BLOCK = 8 << 20


def scan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The columns of a Parquet table, and no others; a missing one is an error."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"{path} lacks {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def pinned_url(host: str, repository: str, revision: str, path: str) -> str:
    """The address of a file at a fixed revision."""
    return f"{host.rstrip('/')}/{quote(repository, safe='/')}/resolve/{quote(revision, safe='')}/{quote(path, safe='/')}"


def file_digest(path: str) -> str:
    """SHA-256 of a file of any size, block by block."""
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while block := file.read(BLOCK):
            digest.update(block)
    return digest.hexdigest()


@dataclass(frozen=True)
class Artifact:
    """A file with the size and SHA-256 it must have."""

    path: str
    size: int
    sha256: str


def verify(spark: SparkSession, artifacts: list[Artifact], resolve: Callable[[str], str] = lambda p: p, count: int | None = None, total: int | None = None) -> DataFrame:
    """The artifacts as read (name, length, sha256), after checking sizes, digests and, if given, their number and total size; Spark reads and hashes them."""
    if count is not None and len(artifacts) != count or total is not None and sum(a.size for a in artifacts) != total:
        raise ContractError("the manifest's number of artifacts or their total size is wrong")
    wanted = spark.createDataFrame([(Path(resolve(a.path)).name, a.size, a.sha256) for a in artifacts], "name string, size bigint, expected string")
    files = spark.read.format("binaryFile").load([resolve(a.path) for a in artifacts])
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))
    both = wanted.join(found, "name", "left")
    require_none(both.where("length is null or length <> size or sha256 <> expected"), "artifacts differ from their manifest")
    return both.select("name", "length", "sha256")


def strict_json(text: str, keys: set[str] | None = None) -> dict:
    """A JSON object without repeated keys, NaN or infinities and, if given, with exactly these keys."""

    def pairs(items: list[tuple[str, object]]) -> dict:
        names = [k for k, _ in items]
        if len(set(names)) != len(names):
            raise ContractError("a key is repeated")
        return dict(items)

    def constant(name: str) -> None:
        raise ContractError(f"{name} is no JSON number")

    value = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    if not isinstance(value, dict):
        raise ContractError("expected an object")
    if keys is not None and set(value) != keys:
        raise ContractError(f"keys differ: {sorted(set(value) ^ keys)}")
    return value


def source_manifest(paths: list[str], root: str) -> dict[str, object]:
    """Digests of files under ``root`` (null for an absent one) and a digest of them all."""
    found = {p: file_digest(os.path.join(root, p)) if os.path.isfile(os.path.join(root, p)) else None for p in sorted(paths)}
    return {"files": found, "sha256": hashlib.sha256(json.dumps(found, sort_keys=True, separators=(",", ":")).encode()).hexdigest()}


def preflight(path: str, overwrite: bool = False) -> None:
    """An output must not be a folder, nor exist unless it may be replaced."""
    if os.path.isdir(path):
        raise IsADirectoryError(path)
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)


def write_json(path: str, value: Mapping[str, object], overwrite: bool = False) -> None:
    """Write a report whole or not at all."""
    preflight(path, overwrite)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".report-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as file:
            json.dump(value, file, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False)
            file.write("\n")
        if overwrite:
            os.replace(temporary, path)
        else:
            os.link(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write a table; an existing one is an error unless it may be replaced."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
