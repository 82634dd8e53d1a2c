"""Tokenizing, blank tests, word windows and prompts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The prompt around a query.
PROMPT_HEAD, PROMPT_MARK, PROMPT_MARKS = "Question: ", "<unused0>", 5
_RUN = re.compile(r"[^\W_]+")


def tokens_of(text: str) -> list[str]:
    """Maximal alphanumeric runs of the NFKC form, case folded."""
    return _RUN.findall(unicodedata.normalize("NFKC", text).casefold())


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokenize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Tokens of a text in full Unicode; null for null."""
    for batch in batches:
        yield batch.map(lambda t: None if t is None else tokens_of(t))


def tokenize_plain(text: Column) -> Column:
    """Tokens by built-in functions alone: lower case, German sharp s and final sigma folded.

    The same as ``tokenize`` for text in NFKC whose other letters fold as they lower.
    """
    folded = F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def words(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def is_blank(text: Column) -> Column:
    """Whether a text is there but holds white space at most."""
    return text.isNotNull() & ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def check_windows(max_words: int, overlap: int) -> None:
    """Windows need 0 <= overlap < max_words."""
    for value in (max_words, overlap):
        if isinstance(value, bool) or not isinstance(value, int):
            raise TypeError("window sizes must be integers")
    if not 0 <= overlap < max_words:
        raise ValueError("windows need 0 <= overlap < max_words")


def chunk_windows(df: DataFrame, text: str, max_words: int = 256, overlap: int = 32, chunk: str = "chunk", chunks: str | None = None) -> DataFrame:
    """``df`` with a row for each window of words: ``chunk`` (from 0), ``words`` and, if named, the number of chunks.

    Windows step by ``max_words - overlap`` and the last one ends the text.  A blank text has one window
    without words; a null text none.
    """
    check_windows(max_words, overlap)
    step = max_words - overlap
    split = df.where(F.col(text).isNotNull()).withColumn("words_", words(F.col(text)))
    last = F.greatest(F.lit(0), F.ceil((F.size("words_") - max_words) / F.lit(step))).cast("int")
    at = split.withColumn(chunk, F.explode(F.sequence(F.lit(0), last)))
    at = at.withColumn("words", F.slice("words_", F.col(chunk) * step + 1, F.lit(max_words)))
    return (at.withColumn(chunks, last + 1) if chunks else at).drop("words_")


def prompt(query: Column) -> Column:
    """The prompt of a query; null for a blank one and for one that holds the reserved mark."""
    good = ~is_blank(query) & ~F.contains(query, F.lit(PROMPT_MARK))
    return F.when(good, F.concat(F.lit(PROMPT_HEAD), query, F.lit(PROMPT_MARK * PROMPT_MARKS)))
