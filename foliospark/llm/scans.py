"""Repair of text from scanned pages: a character editor trained as an averaged perceptron, and a model of page positions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import editor as ed
from foliospark.llm import pages as pg
from foliospark.llm.editor import Break, Edit, Editor, Lexicon
from foliospark.llm.lookalikes import _OTHER_SCRIPT, CLASSES, fold
from foliospark.llm.pages import Pages
from foliospark.session import spread, written

#: The commonest words of the corpus: training words and their counts are taken from these, and texts don't ask for those
#: of them that are right.  All other words are looked up in the table of all words.
COMMON_WORDS = 60_000
#: Pairs of words a step apart, texts, and words beside numbers that training takes at most.
TRAINING_PAIRS, NUMBER_WORDS = 20_000, 1_000

HYPHENS = "-‐¬­="
SOFT = "¬­="
_BROKEN = re.compile(rf"[{HYPHENS}](?<=[^\W\d_].)[ \t]*\n[\s\x0c]*(?=[^\W\d_])")
_LINE_MARK = re.compile(rf"[{HYPHENS}][ \t\r]*[\n\x0c]")
_WORD = re.compile(r"[^\W_]+(?:[!(](?=[^\W\d_])[^\W_]+)*")
_OPEN_WORD = re.compile(r"(?<=\s)[(!](?=[a-zß-öø-ÿα-ώа-я])[^\W_]+(?:[!(](?=[^\W\d_])[^\W_]+)*")
_OPEN = re.compile(r"\s[(!][a-zß-öø-ÿα-ώа-я]")
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
_HANGING = re.compile(r"[^\W\d_]- ([^\W\d_]+)")
_NUMBER_LINE = re.compile(r"\n([^\W\d_]{3,12} \d{1,4}(?: [^\W\d_]{2,4} \d{1,4})?)(?=\n)")
_CODE = re.compile(r"[A-Z0-9]*\d[A-Z0-9]*|[^\W\d_a-zß-öø-ÿα-ώа-яё]+|\d+[a-z]{0,3}|[a-z]{1,3}\d+")
_CAPITALS = re.compile(r"(?!.*SS)[A-Z][A-Z]{1,}\d?[A-Z]{3,}")
_LEFT, _RIGHT = re.compile(r"[^\W\d_]+$"), re.compile(r"\s*([^\W\d_]+)")
_CELL = re.compile(r"\.{3,}| : |:$|^\W*$")
_OPENER = re.compile(r"[#*•→>·▪(\[{]|[-–—] ")


def canonical(text: str) -> str:
    """The text with look-alikes, width forms and ignorable characters out of the way."""
    text = fold(text)
    return text.translate(CLASSES) if not text.isascii() and _OTHER_SCRIPT.search(text) else text


def words_of(text: str) -> set[str]:
    """The distinct words of a canonical text as they stand, broken ones joined."""
    if _LINE_MARK.search(text):
        text = _BROKEN.sub("", text)
    words = set(_WORD.findall(text))
    if _OPEN.search(text):
        words.update(_OPEN_WORD.findall(text))
    return words


def plain(word: str) -> str | None:
    """A word as it is counted, in lower case; None for numbers and codes.

    Codes are digits with a few letters, and capitals with digits among them or alone, unless they are long and plain
    enough to be a word set in capitals (their look-alikes are classed as capitals, so only words of ASCII letters are asked).
    """
    if _CODE.fullmatch(word) and not (_CAPITALS.fullmatch(word) and (word.isalpha() or len(word) > 6)):
        return None
    return word.lower()


def breaks(text: str, skip: Iterable[int] = ()) -> Iterator[tuple[int, int, Break]]:
    """Marks at the ends of lines between two parts of words: line, the next line with content, and the parts.  Lines of ``skip`` don't count."""
    lines, skip = pg.lines_of(text), set(skip)
    for i, raw in enumerate(lines[:-1]):
        line = raw.rstrip()
        if not line or line[-1] not in HYPHENS or i in skip:
            continue
        left = _LEFT.search(line[:-1])
        if not left:
            continue
        j = i + 1
        while j < len(lines) and (not lines[j].strip() or j in skip):
            j += 1
        right = _RIGHT.match(lines[j]) if j < len(lines) else None
        if not right or right[1][0].isupper() and not left[0].isupper():
            continue
        a = left[0]
        before = line[-2 - len(a) : -1 - len(a)]
        yield i, j, Break(a, right[1], line[-1] in SOFT, before in ("-", "‐", "‑") and before != "", before.isdigit() or lines[j].strip()[len(right[1]) : len(right[1]) + 1].isdigit())


@dataclass
class Reader:
    """Reads a text: what it shows of furniture, line ends, and words that need looking up."""

    pages: Pages
    common: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self.known: set[str] = set()  # words as they stand that need no look, kept up to a bound

    def __call__(self, text: str) -> tuple[list[pg.Line], list[tuple[int, int, Break]], set[str]]:
        """Of a canonical text the possible furniture, the marks at line ends, and its words outside ``common`` as they stand."""
        lines = self.pages(text)
        found = list(breaks(text, (x.at for x in lines if x.score > 0))) if _LINE_MARK.search(text) else []
        words = set()
        if len(self.known) > 300_000:
            self.known.clear()
        for w in words_of(text) - self.known:
            if len(w) < 3 or w.lower() in self.common or plain(w) is None:
                self.known.add(w)
            else:
                words.add(w)
        if found:  # the parts of words that furniture keeps apart are no words
            words -= {part for _, j, b in found for part in (b.left, b.right)}
        return lines, found, words


def _drop(lines: list[pg.Line], heads: set[str]) -> set[int]:
    return {x.at for x in lines if x.score > 0 or x.shown and not heads.isdisjoint(x.parts)}


def repaired_text(text: str, reader: Reader, heads: set[str], line_ends: Mapping[Break, str], printed: Mapping[str, str]) -> str:
    """One text as continuous paragraphs: furniture removed, broken words joined, misread words restored.

    ``heads`` are those that other texts show, ``line_ends`` the operations at line ends, ``printed`` the misread words.
    """
    text = fold(text)
    shape = canonical(text)
    lines = reader.pages(shape)
    drop = _drop(lines, heads)
    joins = {i: line_ends.get(b, "apart") for i, _, b in breaks(shape, drop)}
    out: list[str] = []
    paragraph, glue = "", False
    for i, line in enumerate(pg.lines_of(text)):
        line = line.strip("\x0c \t\r")
        if i in drop or not line:
            if not line and paragraph and not glue and pg.ENDED.search(paragraph):
                out.append(paragraph)
                paragraph = ""
            continue
        if not paragraph:
            paragraph = line
        elif glue:
            paragraph += line
        elif pg.ENDED.search(paragraph) and not line[0].islower() or _OPENER.match(line) or _CELL.search(line) or pg.PARTS.search(line) or pg.head_parts(canonical(line)) and pg.styled(line) or pg.head_parts(canonical(paragraph)) and pg.styled(paragraph):
            if pg.ENDED.search(paragraph) and line[0].isalpha() and "\n" not in paragraph and not (_CELL.search(line) or pg.PARTS.search(line) or _OPENER.match(line)):
                paragraph += " " + line
            else:
                out.append(paragraph)
                paragraph = line
        else:
            paragraph += " " + line
        glue = joins.get(i, "apart") != "apart"
        if joins.get(i) == "join":
            paragraph = paragraph[:-1]
    if paragraph:
        out.append(paragraph)
    whole = "\n\n".join(out)
    if printed:

        def fix(m: re.Match[str]) -> str:
            word = plain(canonical(m[0]))
            right = printed.get(word) if word is not None else None
            if right is None:
                return m[0]
            letters = [c for c in m[0] if c.isalpha()]
            return right.upper() if len(letters) > 1 and all(c.isupper() for c in letters) else right.capitalize() if m[0][0].isupper() or (m[0][0] in "0156893" and m[0][1:2].isupper()) else right

        whole = _OPEN_WORD.sub(fix, _WORD.sub(fix, whole)) if _OPEN.search(whole) else _WORD.sub(fix, whole)
    return whole


# ---- Words of the corpus -----------------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold each word; "a-b" for compounds, "- b" after a hanging hyphen, and for a word that stands with a number on lines of its own "# w", "= w" if always the same number, "~ w" if not."""
    counts: Counter[str] = Counter()
    raw: Counter[str] = Counter()

    def give() -> pa.RecordBatch:
        for word, n in raw.items():
            w = plain(word)
            if w:
                counts[w] += n
        raw.clear()
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for value in batch.column(0).to_pylist():
            text = canonical(value)
            raw.update(words_of(text))
            if "-" in text:
                counts.update({c.lower() for part in text.split() if "-" in part for c in _COMPOUND.findall(part)})
                if "- " in text:
                    counts.update({f"- {w.lower()}" for w in _HANGING.findall(text)})
            worded: dict[str, list[str]] = {}
            for line in _NUMBER_LINE.findall(f"\n{text}\n"):
                if line[0].isupper() and (w := pg.number_word(line)):
                    worded.setdefault(w, []).append(line)
            for w, own in worded.items():
                counts[f"# {w}"] += 1
                if len(own) > 1:
                    counts[f"{'=' if len(set(own)) == 1 else '~'} {w}"] += 1
        if len(raw) > 300_000 or len(counts) > 300_000:
            yield give()
    yield give()


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """word, n: how many texts hold each word, over all texts and words."""
    rows = spread(df.select(F.col(f"`{text}`").alias("t")).where("t is not null"))
    return rows.mapInArrow(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def number_words(counts: Mapping[str, int]) -> dict[str, int]:
    """Words that stand beside page numbers, by how much of their use that is: 1 to 3."""
    found = {}
    for key, n in counts.items():
        if key.startswith("# ") and n >= 3:
            word = key[2:]
            share = n / max(counts.get(word, 0), n)
            if share >= 0.05 and counts.get(f"~ {word}", 0) >= counts.get(f"= {word}", 0):
                found[word] = 1 if share < 0.2 else 2 if share < 0.6 else 3
    return found


def _patterns(words: DataFrame) -> DataFrame:
    """Each word with the hashes of what stands around its regions of one and two characters: word, n, size, pattern."""
    one = "transform(filter(sequence(1, length(word)), i -> length(word) > 2), i -> struct(1 as size, xxhash64(substring(word, 1, i - 1), substring(word, i + 1)) as pattern))"
    two = "transform(filter(sequence(1, length(word) - 1), i -> length(word) > 3), i -> struct(2 as size, xxhash64(substring(word, 1, i - 1), substring(word, i + 2)) as pattern))"
    return words.where("length(word) > 2").select("word", "n", F.explode(F.expr(f"concat({one}, {two})")).alias("r")).select("word", "n", "r.size", "r.pattern")


def step_pairs(words: DataFrame) -> DataFrame:
    """word, n, printed, known, at, noisy, clean: every word with every printed one that one edit of one or two characters away.

    Words meet by what stands around the characters that differ, in a join over the whole table of words: a pattern
    leaves at most two characters open, so no key has more words than pairs of characters.
    """
    single = words.where("word not rlike '^[-#=~] ' and word not like '%-%'")
    printed = _patterns(single.where(f"n >= {ed.PRINTED} and word rlike '^\\\\p{{L}}+$'")).select(F.col("word").alias("printed"), F.col("n").alias("known"), F.col("size").alias("size_"), "pattern")
    met = _patterns(single).join(printed, "pattern").where(f"size + size_ < 4 and word <> printed and known >= {ed.RATIO} * n").select("word", "n", "printed", "known").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits = [ed.between(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            good = pa.array([e is not None for e in edits], pa.bool_())
            kept = [e for e in edits if e is not None]
            own = pa.RecordBatch.from_arrays(batch.columns, ["word", "n", "printed", "known"]).filter(good)
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array([e.at for e in kept], pa.int32()), pa.array([e.noisy for e in kept], pa.string()), pa.array([e.clean for e in kept], pa.string())], ["word", "n", "printed", "known", "at", "noisy", "clean"])

    return met.mapInArrow(run, "word string, n bigint, printed string, known bigint, at int, noisy string, clean string")


@dataclass
class Model:
    """What a corpus teaches: its words with counts, words a step apart, the trained editor and page model, and common words that are right."""

    words: DataFrame
    pairs: DataFrame
    editor: Editor
    pages: Pages
    common: frozenset[str]
    wrong: DataFrame


def train(df: DataFrame, text: str = "text", editor: Editor | None = None, pages: Pages | None = None) -> Model:
    """Counts of all words over all texts, and the two perceptrons.

    The perceptrons are trained on the driver on bounded samples: up to COMMON_WORDS words, TRAINING_PAIRS pairs and
    ``pages.TRAINING_PAGES`` texts, chosen by hash.  Counts, pairs and confusions are of the whole corpus.
    """
    rows = df.select(F.col(f"`{text}`").alias("t")).where("t is not null")
    return of_words(rows, written(word_counts(df, text)), editor, pages)


def of_words(rows: DataFrame, words: DataFrame, editor: Editor | None = None, pages: Pages | None = None) -> Model:
    """``train`` with the words counted."""
    pairs = written(step_pairs(words))
    top = words.where("word not rlike '^[#=~] '").orderBy(F.desc("n"), "word").limit(COMMON_WORDS)
    common = {r[0]: r[1] for r in top.collect()}
    if editor is None:
        best = pairs.groupBy("word").agg(F.max(F.struct("known", "noisy", "clean")).alias("best")).groupBy("best.noisy", "best.clean").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        channel = {(r[0], r[1]): r[2] for r in best.collect()}  # bounded by the alphabets: characters to the third
        sample = pairs.orderBy(F.xxhash64("word"), "word", "printed").limit(TRAINING_PAIRS).select("word", "n", "printed", "known").collect()
        editor = ed.trained(common, [tuple(r) for r in sample], channel)
    if pages is None:
        beside = words.where("word rlike '^[#=~] ' and n > 0").orderBy(F.desc("n"), "word").limit(3 * NUMBER_WORDS).collect()
        counted = dict(common) | {r[0]: r[1] for r in beside}
        missing = [w[2:] for w in counted if w.startswith("# ") and w[2:] not in counted]
        counted |= {r[0]: r[1] for r in words.where(F.col("word").isin(missing)).collect()} if missing else {}
        known = number_words(counted)
        texts = rows.where("length(t) > 0").orderBy(F.xxhash64("t")).limit(pg.TRAINING_PAGES).collect()
        pages = pg.trained([canonical(r[0]) for r in texts], known)
    wrong = written(_wrong(words, pairs, editor))
    odd = {w for w in common if ed.ODD.search(w)}
    bad = {r[0] for r in wrong.join(F.broadcast(top.select("word")), "word", "left_semi").select("word").collect()}
    return Model(words, pairs, editor, pages, frozenset(set(common) - odd - bad), wrong)


def _wrong(words: DataFrame, pairs: DataFrame, editor: Editor) -> DataFrame:
    """word, printed: the misread words of the table and what was printed; each word is decided once, by all it could be."""
    shared = words.sparkSession.sparkContext.broadcast((editor.channel, editor.perceptron.weights))
    schema = "word string, gain double, printed string"

    def own() -> Editor:
        channel, weights = shared.value
        return Editor(channel, ed.Perceptron(weights))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = own()
        for batch in batches:
            word, n, printed, known, at, noisy, clean = (c.to_pylist() for c in batch.columns)
            gains = [e.gain(w, c, (Edit(a, x, y),), k) for w, c, k, a, x, y in zip(word, n, known, at, noisy, clean)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gains, pa.float64()), batch.column(2)], ["word", "gain", "printed"])

    # What printed words are made of: all their runs of three letters, ends marked; bounded by the alphabets.
    ends = words.where(f"n >= {ed.PRINTED} and word not rlike '^[-#=~] ' and word not like '%-%'").select(F.concat(F.lit("^"), "word", F.lit("$")).alias("w"))
    threes = ends.select(F.explode(F.expr("transform(sequence(1, length(w) - 2), i -> substring(w, i, 3))")).alias("three")).distinct()
    made_of = words.sparkSession.sparkContext.broadcast({r[0] for r in threes.collect()})

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, runs = own(), made_of.value

        def give(found: list[tuple]) -> pa.RecordBatch:
            word, n, made, at, noisy, clean = zip(*found)
            parts = [pa.array(at, pa.list_(pa.int32())), pa.array(noisy, pa.list_(pa.string())), pa.array(clean, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(made, pa.string()), *parts], ["word", "n", "made", "at", "noisy", "clean"])

        found: list[tuple] = []
        for batch in batches:
            for w, n in zip(*(c.to_pylist() for c in batch.columns)):
                for made, edits in e.guesses(w):
                    if len(edits) > 1 and not all(f"^{made}$"[i : i + 3] in runs for i in range(len(made))):
                        continue  # no printed word
                    found.append((w, n, made, [x.at for x in edits], [x.noisy for x in edits], [x.clean for x in edits]))
                if len(found) > 5_000:
                    yield give(found)
                    found = []
        if found:
            yield give(found)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = own()
        for batch in batches:
            word, n, _, at, noisy, clean, known = (c.to_pylist() for c in batch.columns)
            gains = [e.gain(w, c, tuple(map(Edit, a, x, y)), k) for w, c, a, x, y, k in zip(word, n, at, noisy, clean, known)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gains, pa.float64()), batch.column(2)], ["word", "gain", "printed"])

    near = pairs.mapInArrow(one, schema)
    alone = words.where("length(word) > 2 and word not rlike '^[-#=~] ' and word not like '%-%'").join(pairs.select("word"), "word", "left_anti")
    guesses = alone.select("word", "n").mapInArrow(guess, "word string, n bigint, made string, at array<int>, noisy array<string>, clean array<string>")
    known = guesses.join(words.select(F.col("word").alias("made"), F.col("n").alias("known")), "made", "left").select("word", "n", "made", "at", "noisy", "clean", F.coalesce("known", F.lit(0)).cast("bigint").alias("known"))
    far = known.where(f"size(at) = 1 or known >= {ed.RATIO} * n").mapInArrow(several, schema)
    best = near.union(far).where("gain > 0").groupBy("word").agg(F.max(F.struct("gain", "printed")).alias("best"))
    return best.select("word", "best.printed")


# ---- Evidence of texts -------------------------------------------------------------------------------------

_BREAK = "struct<left: string, right: string, soft: boolean, chained: boolean, code: boolean>"
_HEAD = "struct<head: string, score: double, first: boolean>"


def _evidence(rows: DataFrame, model: Model) -> DataFrame:
    """Of every row (row, bundle, text): whether it shows page numbers, its possible heads, its marks at line ends, and words to look up."""
    shared = rows.sparkSession.sparkContext.broadcast((model.pages.perceptron.weights, model.pages.words, model.common))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, words, common = shared.value
        read = Reader(Pages(ed.Perceptron(weights), words), common)
        head = pa.list_(pa.struct([("head", pa.string()), ("score", pa.float64()), ("first", pa.bool_())]))
        broken = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string()), ("soft", pa.bool_()), ("chained", pa.bool_()), ("code", pa.bool_())]))
        for batch in batches:
            numbers, heads, ends, open_words = [], [], [], []
            for text in batch.column(2).to_pylist():
                lines, found, left = read(canonical(text))
                numbers.append(any(x.number and x.score > 0 for x in lines))
                best: dict[str, tuple[float, bool]] = {}
                for x in lines:
                    if x.parts and (x.score > 0 or x.shown):
                        for p in x.parts:
                            best[p] = max(best.get(p, (x.score, x.first)), (x.score, x.first))
                heads.append([{"head": p, "score": s, "first": f} for p, (s, f) in best.items()])
                ends.append([b.__dict__ for b in {b for _, _, b in found}])
                open_words.append(list({plain(w) for w in left}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers), pa.array(heads, head), pa.array(ends, broken), pa.array(open_words, pa.list_(pa.string()))], ["row", "bundle", "numbers", "heads", "ends", "words"])

    read = spread(rows.where("text is not null")).mapInArrow(run, f"row {kind}, bundle string, numbers boolean, heads array<{_HEAD}>, ends array<{_BREAK}>, words array<string>")
    return read.where("numbers or size(heads) > 0 or size(ends) > 0 or size(words) > 0")


def _heads(evidence: DataFrame, pages: Pages) -> DataFrame:
    """row, head: running heads that a text shows itself, and those that it shows together with other texts."""
    heads = evidence.select("row", "bundle", F.explode("heads").alias("h")).select("row", "bundle", "h.head", "h.score", "h.first")
    sure, maybe = heads.where("score > 0"), heads.where("score <= 0")
    elsewhere = sure.groupBy("head").agg(F.count(F.lit(1)).alias("elsewhere"))
    together = maybe.where("bundle is not null").groupBy("bundle", "head").agg(F.count(F.lit(1)).alias("together"))
    weigh = pages.perceptron.weights.get
    weights = {}
    for a in range(3):
        for b in range(5):
            for first in (False, True):
                weights[f"{a} {b} {str(first).lower()}"] = sum(weigh(f, 0.0) for f in pg.shared_features(a, b, first))
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    both = maybe.join(elsewhere, "head", "left").join(together, ["bundle", "head"], "left")
    fact = F.concat_ws(" ", F.least(F.coalesce("elsewhere", F.lit(0)), F.lit(2)), F.least(F.coalesce("together", F.lit(0)), F.lit(4)), F.col("first"))
    shown = both.where(F.col("score") + F.element_at(table, fact) > 0)
    return sure.select("row", "head").union(shown.select("row", "head"))


def _line_ends(evidence: DataFrame, model: Model) -> DataFrame:
    """b, op: every kind of mark at a line end of the corpus with its operation, by the counts of all words it may make."""
    shared = evidence.sparkSession.sparkContext.broadcast((model.editor.channel, model.editor.perceptron.weights))
    each = evidence.select(F.explode("ends").alias("b")).distinct()
    a, b = F.lower("b.left"), F.lower("b.right")
    keys = each.select("b", F.posexplode(F.array(F.concat(a, b), F.concat_ws("-", a, b), a, b, F.concat(F.lit("- "), b))).alias("role", "word"))
    counted = keys.join(model.words, "word", "left").groupBy("b").agg(F.map_from_entries(F.collect_list(F.struct("role", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))).alias("counts"))
    flat = counted.select("b.left", "b.right", "b.soft", "b.chained", "b.code", *[F.element_at("counts", F.lit(i)).alias(f"n{i}") for i in range(5)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, weights = shared.value
        e = Editor(channel, ed.Perceptron(weights))
        for batch in batches:
            done = []
            for left, right, soft, chained, code, *n in zip(*(c.to_pylist() for c in batch.columns)):
                found = Break(left, right, soft, chained, code)
                done.append(e.at_line_end(found, dict(zip(found.keys, n))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(done, pa.string())], ["left", "right", "soft", "chained", "code", "op"])

    decided = flat.mapInArrow(run, "left string, right string, soft boolean, chained boolean, code boolean, op string")
    return decided.select(F.struct("left", "right", "soft", "chained", "code").alias("b"), "op")


def _group(bundle: str | None) -> Column:
    return F.col(f"`{bundle}`").cast("string") if bundle else F.lit(None).cast("string")


def find_noise(df: DataFrame, key: str = "doc_id", text: str = "text", bundle: str | None = "bundle_id", model: Model | None = None) -> DataFrame:
    """One row per text and kind of noise in it: the key and ``noise`` (hyphen, glyph, header or pageno).

    A word broken over a line end is one whose parts the editor joins without their mark; a misread word one that
    the editor changes; page numbers and running heads are lines that the page model takes for furniture, by
    their place and repetition within the text and in other texts.

    Null, empty and blank texts have no noise; without a bundle only the text itself and heads shown elsewhere are
    asked.  A null key is left out; a repeated row counts once.
    """
    model = model or train(df, text)
    rows = df.select(F.col(f"`{key}`").alias("row"), _group(bundle).alias("bundle"), F.col(f"`{text}`").alias("text")).where("row is not null")
    evidence = written(_evidence(rows, model))
    numbers = evidence.where("numbers").select("row", F.lit("pageno").alias("noise"))
    heads = _heads(evidence, model.pages).select("row", F.lit("header").alias("noise"))
    glyphs = evidence.select("row", F.explode("words").alias("word")).join(model.wrong.select("word"), "word", "left_semi").select("row", F.lit("glyph").alias("noise"))
    joined = _line_ends(evidence, model).where("op = 'join'").select("b")
    hyphens = evidence.select("row", F.explode("ends").alias("b")).join(joined, "b", "left_semi").select("row", F.lit("hyphen").alias("noise"))
    return numbers.union(heads).union(glyphs).union(hyphens).distinct().withColumnRenamed("row", key)


def repair(df: DataFrame, key: str = "doc_id", text: str = "text", bundle: str | None = "bundle_id", model: Model | None = None) -> DataFrame:
    """Every text as continuous, readable paragraphs: the key and ``text``.

    Null stays null and empty stays empty; keys may be null or repeated.  Other columns are dropped.
    """
    model = model or train(df, text)
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), _group(bundle).alias("bundle"), F.col(f"`{text}`").alias("text"))
    rows = written(rows)
    evidence = written(_evidence(rows.select("row", "bundle", "text"), model))
    heads = _heads(evidence, model.pages).groupBy("row").agg(F.collect_set("head").alias("heads"))
    fixes = evidence.select("row", F.explode("words").alias("word")).join(model.wrong, "word").groupBy("row").agg(F.collect_list(F.struct("word", "printed")).alias("fixes"))
    ends = evidence.select("row", F.explode("ends").alias("b")).join(_line_ends(evidence, model), "b").groupBy("row").agg(F.collect_list(F.struct("b", "op")).alias("ends"))
    shared = df.sparkSession.sparkContext.broadcast((model.pages.perceptron.weights, model.pages.words))
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, words = shared.value
        reader = Reader(Pages(ed.Perceptron(weights), words))
        for batch in batches:
            done = []
            for t, h, f, e in zip(*(c.to_pylist() for c in batch.columns[1:])):
                ops = {Break(**x["b"]): x["op"] for x in e or ()}
                done.append(None if t is None else repaired_text(t, reader, set(h or ()), ops, {x["word"]: x["printed"] for x in f or ()}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], [key, text])

    whole = rows.join(heads, "row", "left").join(fixes, "row", "left").join(ends, "row", "left")
    return whole.select("key", "text", "heads", "fixes", "ends").mapInArrow(run, f"`{key}` {key_type}, `{text}` string")


# ---- In memory ------------------------------------------------------------------------------------------------


@dataclass
class Local:
    """The same decisions for single texts, with a lexicon in memory."""

    lexicon: Lexicon
    editor: Editor
    pages: Pages

    @classmethod
    def of(cls, words: dict[str, int], texts: list[str]) -> Local:
        """Trained on counted words and canonical texts."""
        lexicon = Lexicon(words)
        return cls(lexicon, lexicon.editor(), pg.trained(texts, number_words(words)))

    def model(self, spark: SparkSession) -> Model:
        """The same model for tables."""
        words = spark.createDataFrame(sorted(self.lexicon.words.items()), "word string, n bigint")
        return of_words(spark.createDataFrame([], "t string"), words, self.editor, self.pages)

    def misread(self, text: str) -> dict[str, str]:
        """The misread words of a text, as they stand, and what was printed, in lower case."""
        words = Reader(self.pages)(canonical(text))[2]
        return {w: said for w in words if (said := self.lexicon.restored(self.editor, plain(w))) != plain(w)}

    def noise(self, text: str) -> list[str]:
        """Kinds of noise that the text shows by itself."""
        lines, found, _ = Reader(self.pages)(canonical(text))
        kinds = {"pageno" for x in lines if x.number and x.score > 0} | {"header" for x in lines if x.parts and x.score > 0}
        kinds |= {"hyphen" for _, _, b in found if self.editor.at_line_end(b, self.lexicon.words) == "join"}
        return sorted(kinds | ({"glyph"} if self.misread(text) else set()))
