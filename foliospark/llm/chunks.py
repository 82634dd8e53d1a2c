"""Splitting long texts at natural boundaries by packing a structure tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import bounded_rows, spread

#: Code points with the Unicode property White_Space.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LINE_ENDS = [0x0A, 0x0B, 0x85, 0x2028]
PAGE_ENDS = [0x0C, 0x2029]
SENTENCE_ENDS = ".!?…。！？"
CLAUSE_ENDS = ",;:，；：、"
CLOSERS = "\"')]}”’»」"
BULLETS = "-*•→+·▪–"

# Levels of the tree: the strength of the gap between two words.  Items of a list stand between ROW and TABLE, deeper
# ones lower; headings above HEADING, deeper ones lower; what marks an item is glued to it.
GLUE, WORD, CLAUSE, SENTENCE, LINE, ROW, TABLE, PARAGRAPH, PAGE, HEADING = -1, 0, 10, 20, 30, 32, 42, 45, 50, 60
#: Depths of items that are told apart.
DEPTHS = 8
#: A number or letter that marks an item, such as "3.", "(12)", "b)", "iv." or "2.1".
_NUMBERED = re.compile(r"\(?(?:\d{1,3}|[A-Za-z]|[ivxlc]{2,6})[.)]|(?:\d{1,3}\.){1,5}\d{1,3}\.?")
#: Opening and closing tags by the level of the gap before them.
_TAG = re.compile(r"</?(?:(h)([1-6])|(p|div|section|ul|ol|table|blockquote|pre)|(li|tr|dt|dd)|(br|td|th))\b", re.IGNORECASE)


def _flags(chars: str | list[int]) -> np.ndarray:
    table = np.zeros(0x10000, dtype=bool)
    table[[c if isinstance(c, int) else ord(c) for c in chars]] = True
    return table


IS_SPACE, IS_LINE, IS_PAGE = _flags(SPACES), _flags(LINE_ENDS), _flags(PAGE_ENDS)
IS_SENTENCE, IS_CLAUSE, IS_CLOSER, IS_BULLET = map(_flags, (SENTENCE_ENDS, CLAUSE_ENDS, CLOSERS, BULLETS))
IS_MARK, IS_DIGIT = _flags(".)"), _flags("0123456789")
IS_UPPER = _flags([c for c in range(0x10000) if chr(c).isupper()])
IS_LOWER = _flags([c for c in range(0x10000) if chr(c).islower()])


@dataclass(frozen=True)
class Chunking:
    """A chunking: pieces of at most ``max_words`` words, neighbours sharing ``overlap_words``."""

    name: str
    max_words: int
    overlap_words: int

    @property
    def fresh(self) -> int:
        """Words of a piece that its predecessor doesn't hold."""
        return self.max_words - self.overlap_words


def code_points(text: str) -> np.ndarray:
    """The code points of ``text``, those beyond the basic plane as a private one that no class holds."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.minimum(points, 0xFFFF).astype(np.uint16)


def word_spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without white space."""
    inside = np.zeros(len(points) + 2, dtype=np.int8)
    inside[1:-1] = ~IS_SPACE[points]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def gap_levels(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Level of the gap after each word but the last: the structure tree, flattened.

    A node of level L is a maximal run of words without a gap of a higher level.  Headings (marked with
    ``#`` or a tag, deeper ones lower, or written in capitals) open sections, form feeds end pages, blank lines
    end paragraphs, the rows of a table and lines after a full sentence stand by themselves, and a line end within
    a sentence is a mere wrap.  Items of lists (bullets, numbers, letters, tags) are nodes whose depth follows
    their indentation or the parts of their number; a mark stays with its item.
    """
    n = len(starts)
    if n < 2:
        return np.zeros(0, dtype=np.int8)
    count = lambda flags: np.concatenate(([0], np.cumsum(flags[points])))
    lines, pages = count(IS_LINE), count(IS_PAGE)
    breaks, feeds = lines[starts[1:]] - lines[ends[:-1]], pages[starts[1:]] - pages[ends[:-1]]
    last = points[ends[:-1] - 1]
    before = points[np.maximum(ends[:-1] - 2, starts[:-1])]
    mark = np.where(IS_CLOSER[last], before, last)
    level = np.zeros(n - 1, dtype=np.int8)
    level[IS_CLAUSE[mark]] = CLAUSE
    level[IS_SENTENCE[mark]] = SENTENCE
    broken = (breaks > 0) | (feeds > 0)
    if not broken.any():
        _tags(points, starts, ends, level)
        return level
    first = points[starts[1:]]
    level[broken & (level == WORD)] = CLAUSE
    level[broken & (level == SENTENCE)] = LINE
    at = np.flatnonzero(broken)
    line_from, line_to = np.concatenate(([0], at + 1)), np.concatenate((at, [n - 1]))
    uppers, lowers = count(IS_UPPER), count(IS_LOWER)
    a, b = starts[line_from], ends[line_to]
    capitals = (uppers[b] - uppers[a] >= 3) & (lowers[b] == lowers[a])
    short_before = at[: len(at)]
    tabular = np.zeros(len(line_from), dtype=bool)
    wide = ((starts[1:] - ends[:-1]) > 1) & ~broken
    wides = np.concatenate(([0], np.cumsum(wide)))
    tabular[:] = wides[line_to] - wides[line_from] > 0
    level[short_before[tabular[1:] & tabular[:-1]]] = ROW
    level[short_before[tabular[1:] != tabular[:-1]]] = TABLE
    _items(points, starts, ends, at, level)
    level[breaks > 1] = PARAGRAPH
    level[feeds > 0] = PAGE
    # A heading opens a section; the gap after it belongs to the section.
    heads = np.flatnonzero(capitals[1:] & ~capitals[:-1])
    level[at[heads]] = HEADING
    hashes = broken & (first == ord("#"))
    for g in np.flatnonzero(hashes):
        deep = int(ends[g + 1] - starts[g + 1])
        if deep <= 6 and (points[starts[g + 1] : ends[g + 1]] == ord("#")).all():
            level[g] = HEADING + 7 - deep
    _tags(points, starts, ends, level)
    return level


def _items(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, level: np.ndarray) -> None:
    """Set the levels of list items, at line ends ``at`` and at the text's first word."""
    opening = np.concatenate(([0], at + 1))
    first = points[starts[opening]]
    size = ends[opening] - starts[opening]
    ends_line = np.zeros(len(starts), dtype=bool)
    ends_line[at] = True
    maybe = IS_BULLET[first] & (size == 1) | IS_MARK[points[ends[opening] - 1]] & (size <= 12) | IS_DIGIT[first] & (size <= 12)
    for w in opening[maybe].tolist():
        word = points[starts[w] : ends[w]].tobytes().decode("utf-16-le", "replace")
        bullet = len(word) == 1 and not word.isalnum()
        if not bullet and not _NUMBERED.fullmatch(word) or w + 1 >= len(starts) or ends_line[w]:
            continue  # a mark that ends its line marks nothing
        if w < len(level):
            level[w] = GLUE
        if w:
            between = points[ends[w - 1] : starts[w]]
            line = np.flatnonzero(IS_LINE[between] | IS_PAGE[between])[-1] + 1
            indent = int((between[line:] == 0x09).sum()) * 4 + int((between[line:] != 0x09).sum())
            depth = min(DEPTHS, indent // 2 + max(0, word.strip("(.)").count(".")))
            level[w - 1] = ROW + 1 + DEPTHS - depth


def _tags(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, level: np.ndarray) -> None:
    """Raise the gaps before tags to what the tags open or close."""
    for w in np.flatnonzero(points[starts] == ord("<")).tolist():
        tag = _TAG.match(points[starts[w] : ends[w]].tobytes().decode("utf-16-le", "replace"))
        if tag and w and not (points[starts[w] + 1] == ord("/") and not tag[3]):
            level[w - 1] = max(level[w - 1], HEADING + 7 - int(tag[2]) if tag[1] else PARAGRAPH if tag[3] else ROW + 1 + DEPTHS if tag[4] else CLAUSE)


def _pack(level: np.ndarray, lo: int, hi: int, limit: int, out: list[tuple[int, int]]) -> None:
    """Append the pieces of the words ``lo`` to ``hi``: oversized nodes opened, their pieces and siblings merged bottom-up to the limit."""
    if hi - lo <= limit:
        out.append((lo, hi))
        return
    inner = level[lo : hi - 1]
    top = int(inner.max())
    if top <= WORD:
        parts = -(-(hi - lo) // limit)
        cuts = [lo + (hi - lo) * p // parts for p in range(parts + 1)]
        for i in range(1, parts):  # a mark goes with its item where the pieces still fit
            if level[cuts[i] - 1] == GLUE and cuts[i + 1] - cuts[i] + 1 <= limit and cuts[i] - 1 > cuts[i - 1]:
                cuts[i] -= 1
        out.extend(zip(cuts[:-1], cuts[1:]))
        return
    cuts = [lo, *(np.flatnonzero(inner == top) + lo + 1).tolist(), hi]
    units: list[tuple[int, int]] = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a > limit:
            _pack(level, a, b, limit, units)
        else:
            units.append((a, b))
    begun, end = units[0]
    for a, b in units[1:]:  # siblings, and what is left over at the ends of opened ones
        if b - begun > limit:
            out.append((begun, end))
            begun = a
        end = b
    out.append((begun, end))


def pack(level: np.ndarray, words: int, chunking: Chunking) -> list[tuple[int, int, int]]:
    """Pieces as (first word, end word, words shared with the piece before); one piece if the text fits."""
    if words <= chunking.max_words:
        return [(0, words, 0)]
    cores: list[tuple[int, int]] = []
    _pack(level, 0, words, chunking.fresh, cores)
    shared = chunking.overlap_words
    # The first piece must be able to lend the overlap: while it can't, it takes words up to the best gap.
    while len(cores) > 1 and cores[0][1] < shared:
        end = min(max(cores[1][1], shared), chunking.max_words)
        if cores[1][1] <= chunking.max_words:
            cores[:2] = [(0, cores[1][1])]
            continue
        window = level[shared - 1 : end - 1]
        best = int(np.flatnonzero(window == window.max())[-1]) + shared
        cores[:2] = [(0, best), (best, cores[1][1])]
    return [(max(0, a - shared) if i else a, b, shared if i else 0) for i, (a, b) in enumerate(cores)]


def split_text(text: str, chunkings: list[Chunking]) -> Iterator[tuple[Chunking, int, int, int, int, int]]:
    """Pieces of one text as (chunking, piece from 1, first word, words, shared words, start, end of characters)."""
    points = code_points(text)
    starts, ends = word_spans(points)
    n = len(starts)
    level = gap_levels(points, starts, ends) if any(n > c.max_words for c in chunkings) else None
    for c in chunkings:
        for i, (a, b, shared) in enumerate(pack(level, n, c) if n > c.max_words else [(0, n, 0)]):
            yield c, i + 1, a, b - a, shared, int(starts[a]) if n else 0, int(ends[b - 1]) if n else 0


def chunkings_of(table: DataFrame) -> list[Chunking]:
    """The chunkings of a parameter table (at most 1,000 rows, checked).

    Rows without a name or with a limit that is null or below 1 are left out; a null overlap is 0, and an
    overlap that leaves no fresh word is cut to ``max_words - 1``.
    """
    rows = bounded_rows(table.select("chunking_name", "max_words", "overlap_words"), 1_000, "the chunking table")
    good = {(r[0], int(r[1]), min(max(0, int(r[2] or 0)), int(r[1]) - 1)) for r in rows if r[0] is not None and r[1] is not None and r[1] >= 1}
    return [Chunking(*x) for x in sorted(good)]


def split_oversized(df: DataFrame, chunkings: list[Chunking], key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """Ordered pieces of every text for every chunking.

    Columns: ``chunking_name``, the key, ``piece`` (from 1), ``first_word`` (from 0), ``words``,
    ``shared_words`` (with the piece before), ``start_char``, ``end_char`` and, unless ``with_text`` is
    off, ``text``: the piece as it stands in the document.  Each text is parsed once for all chunkings.

    A text within the limit is one piece, an empty or blank one a piece of no words; a null text gives no
    rows, a null key is kept.  Repeated rows are split each for itself.  Other columns are dropped.
    """
    key_type = df.schema[key].dataType.simpleString()
    schema = f"chunking_name string, `{key}` {key_type}, piece int, first_word int, words int, shared_words int, start_char int, end_char int" + ", text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            rows: list[tuple] = []
            at: list[int] = []
            pieces: list[str] = []
            for i, value in enumerate(batch.column(1).to_pylist()):
                for c, piece, first, words, shared, start, end in split_text(value, chunkings):
                    rows.append((c.name, piece, first, words, shared, start, end))
                    at.append(i)
                    if with_text:
                        pieces.append(value[start:end])
            if not rows:
                continue
            names, *ints = zip(*rows)
            columns = [pa.array(names, pa.string()), keys.take(pa.array(at, pa.int32())), *(pa.array(x, pa.int32()) for x in ints)]
            if with_text:
                columns.append(pa.array(pieces, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["chunking_name", key, "piece", "first_word", "words", "shared_words", "start_char", "end_char", *["text"] * with_text])

    return spread(df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).where(F.col(f"`{text}`").isNotNull())).mapInArrow(run, schema)
