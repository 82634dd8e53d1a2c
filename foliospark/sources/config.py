"""Configuration records from strict JSON: exact keys, exact types, values in range."""

from __future__ import annotations

import dataclasses
import typing
from dataclasses import dataclass
from pathlib import Path
from typing import Any, TypeVar

from foliospark.operators.bm25 import Parameters
from foliospark.operators.subset import Selection
from foliospark.operators.validate import ContractError
from foliospark.sources.files import strict_json

T = TypeVar("T")


def record(kind: type[T], value: object, where: str = "") -> T:
    """An instance of a frozen dataclass from a mapping with exactly its fields.

    Integers aren't booleans, numbers may be integers, lists become tuples, and nested dataclasses are read alike.
    """
    place = where or kind.__name__
    if not isinstance(value, dict):
        raise ContractError(f"{place}: expected an object")
    hints = typing.get_type_hints(kind)
    names = {f.name for f in dataclasses.fields(kind)}  # type: ignore[arg-type]
    if set(value) != names:
        raise ContractError(f"{place}: keys differ: {sorted(set(value) ^ names)}")
    try:
        return kind(**{n: _typed(hints[n], value[n], f"{place}.{n}") for n in names})
    except (TypeError, ValueError) as e:
        raise e if isinstance(e, ContractError) else ContractError(f"{place}: {e}") from e


def _typed(hint: Any, value: object, where: str) -> Any:
    if dataclasses.is_dataclass(hint):
        return record(hint, value, where)  # type: ignore[arg-type]
    if typing.get_origin(hint) is tuple:
        if not isinstance(value, list) or not value:
            raise ContractError(f"{where}: expected a list that isn't empty")
        return tuple(_typed(typing.get_args(hint)[0], v, f"{where}[{i}]") for i, v in enumerate(value))
    if hint is bool or isinstance(value, bool):
        if hint is not bool or not isinstance(value, bool):
            raise ContractError(f"{where}: expected {hint.__name__}")
        return value
    if hint is float and isinstance(value, int):
        value = float(value)
    if not isinstance(value, hint) or value == "":
        raise ContractError(f"{where}: expected {hint.__name__}")
    return value


def _positive(owner: object, *names: str) -> None:
    for name in names:
        if getattr(owner, name) <= 0:
            raise ContractError(f"{name} must be positive")


@dataclass(frozen=True)
class Case:
    """Sizes of one benchmark case; the active tokens are at most the tokens."""

    name: str
    queries: int
    query_tokens: int
    active_query_tokens: int
    documents: int
    document_tokens: int
    active_document_tokens: int
    width: int

    def __post_init__(self) -> None:
        _positive(self, "queries", "query_tokens", "documents", "document_tokens", "width")
        if not 0 <= self.active_query_tokens <= self.query_tokens or not 0 <= self.active_document_tokens <= self.document_tokens:
            raise ContractError(f"{self.name}: more active tokens than tokens")


@dataclass(frozen=True)
class BenchmarkConfig:
    """A matrix of cases, how often each is run, and how close results must be."""

    seed: int
    warmups: int
    trials: int
    absolute_tolerance: float
    relative_tolerance: float
    cases: tuple[Case, ...]

    def __post_init__(self) -> None:
        _positive(self, "trials")
        if self.warmups < 0 or min(self.absolute_tolerance, self.relative_tolerance) < 0:
            raise ContractError("warmups and tolerances can't be negative")
        if len({c.name for c in self.cases}) < len(self.cases):
            raise ContractError("a case is repeated")


@dataclass(frozen=True)
class TextConfig:
    """A text evaluation: windows and BM25 parameters."""

    max_words: int
    overlap_words: int
    k: int
    bm25: Parameters

    def __post_init__(self) -> None:
        _positive(self, "max_words", "k")
        if not 0 <= self.overlap_words < self.max_words:
            raise ContractError("windows need 0 <= overlap < max_words")


@dataclass(frozen=True)
class SubsetConfig:
    """A subset experiment: the cutoff and the selections of its tasks, each once."""

    k: int
    warmups: int
    selections: tuple[Selection, ...]

    def __post_init__(self) -> None:
        _positive(self, "k")
        if self.warmups < 0 or len({s.task for s in self.selections}) < len(self.selections):
            raise ContractError("warmups can't be negative, and a task has one selection")


def load(kind: type[T], path: str) -> T:
    """A record from a file of strict JSON: no repeated keys, no NaN or infinities."""
    return record(kind, strict_json(Path(path).read_text(encoding="utf-8")))
