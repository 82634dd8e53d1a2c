"""One form for texts that look the same: folding, deletion of ignorable characters, look-alike lattices."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import checkpointed, spread

# Letters that are drawn alike, each line as Latin, then Cyrillic, then Greek ("-": none), then other Latin letters.
LOOKALIKES = """
a а - ɑ
c с ϲ
d ԁ -
e е -
h һ -
i і -
j ј ϳ
l ӏ -
o о ο
p р -
q ԛ -
s ѕ -
v ѵ ν
w ԝ -
x х -
y у -
A А Α
B В Β
C С Ϲ
E Е Ε
F - Ϝ
G Ԍ -
H Н Η
I І Ι
J Ј Ϳ
K К Κ
M М Μ
N - Ν
O О Ο
P Р Ρ
Q Ԛ -
S Ѕ -
T Т Τ
V Ѵ -
W Ԝ -
X Х Χ
Y Ү Υ
Z - Ζ
"""
# Characters drawn as other ones, beyond width forms and compositions.
SAME_AS = {
    "‐": "-", "‑": "-", "µ": "μ", "K": "K", "Å": "Å", "Ω": "Ω", "Ϊ": "Ϊ",
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij",
    "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj",
}
SAME_AS = {k: v for k, v in SAME_AS.items() if len(k) == 1}
# Characters without a shape of their own: Unicode's default ignorable ones, but for the joiners of _SHAPING and tags of flags.
IGNORABLE_RANGES = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0D), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0100, 0xE01EF),
]
IGNORABLE = "".join(f"{chr(a)}-{chr(b)}" if a < b else chr(a) for a, b in IGNORABLE_RANGES)
SCRIPTS = ("latin", "cyrillic", "greek")

_ROWS = [line.split() for line in LOOKALIKES.split("\n") if line]
#: Of each Latin letter with look-alikes: its candidates as (letter, script).
LATTICE = {r[0]: [(c, s) for s, c in enumerate(r[:3]) if c != "-"] for r in _ROWS}
#: Every look-alike to the Latin letter that names its class.
CLASS_OF = {ord(c): r[0] for r in _ROWS for c in r[1:] if c != "-"}


def _fold_table() -> dict[int, str]:
    """Characters that are drawn as others: spaces, width forms, Roman numerals, ligatures."""
    table = {ord(k): v for k, v in SAME_AS.items()}
    for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000):
        table[c] = " "
    # Width forms, Roman numerals, and the radicals of dictionaries, which are drawn as the ideographs.
    for c in (*range(0xFF01, 0xFFA0), *range(0xFFA1, 0xFFEF), *range(0x2160, 0x2180), *range(0x2F00, 0x2FD6)):
        plain = unicodedata.normalize("NFKC", chr(c))
        if plain != chr(c) and unicodedata.category(chr(c)) != "Cn":
            table[c] = plain
    return table


def _class_table() -> dict[int, str]:
    """Every look-alike, with or without an accent, to its Latin class letter with the same accent."""
    table = {c: t for c, t in CLASS_OF.items() if c < 0x370}
    for c in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(c))
        if ord(parts[0]) in CLASS_OF:
            table[c] = unicodedata.normalize("NFC", CLASS_OF[ord(parts[0])] + parts[1:])
    return table


FOLD, CLASSES = _fold_table(), _class_table()
_IGNORABLE = re.compile(f"[{IGNORABLE}]")
_FOLDED = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(FOLD)) + "]")
#: Joiners that shape what is displayed, between letters of joining or Indic scripts and within emoji; a
#: soft hyphen at a line's end, which is displayed.
_SHAPING = re.compile("(?<=[؀-ۿ܀-ݏऀ-෿က-႟ក-៿])[‌‍]+(?=[؀-ۿ܀-ݏऀ-෿က-႟ក-៿])|(?<=[←-⯿️\U0001f000-\U0001faff])‍(?=[←-⯿\U0001f000-\U0001faff])|­(?=[ \t]*(?:\r?\n|\x0c|$))")
#: Anything but composed Latin letters, ideographs and common marks that no step below touches.
_SPECIAL = re.compile("[^\x00-\x0c\x0e-\x7f°±²³½À-ıĴ-ňŊ-ž–—‘’“”•…™→≤≥∑✔、。一-鿿]")
_ASCII_TOKEN = re.compile(r"[A-Za-z]+")
_TOKEN = re.compile(r"[^\W\d_]+")
_MARKED_TOKEN = re.compile("(?:[^\\W\\d_][̀-ͯ]*)+")
_MARKS = re.compile("[̀-ͯ]")
_OTHER_SCRIPT = re.compile("[ɑͰ-ԯἀ-῿]")
_CYRILLIC, _GREEK = re.compile("[Ѐ-ԯ]"), re.compile("[Ͱ-Ͽἀ-῿]")
_PLAIN_LATIN = re.compile("[" + "".join(c for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in LATTICE) + "]")


def script_of(letter: str) -> int:
    """Index in SCRIPTS of a letter, -1 for any other script."""
    c = ord(letter)
    if c < 0x250:
        return 0
    return 1 if 0x400 <= c <= 0x52F else 2 if 0x370 <= c <= 0x3FF else -1


def fold(text: str) -> str:
    """Compatibility normalization and deletion of ignorable characters, composed.

    Only changes that leave the displayed text as it is are made: super- and subscripts, fractions,
    circled letters and the like stay what they are.
    """
    if not _SPECIAL.search(text):
        return text
    if _FOLDED.search(text):
        text = text.translate(FOLD)
    if _IGNORABLE.search(text):
        kept = _SHAPING.sub(lambda m: m[0].translate({0x200C: "\ue00c", 0x200D: "\ue00d", 0xAD: "\ue0ad"}), text)
        text = _IGNORABLE.sub("", kept).translate({0xE00C: "\u200c", 0xE00D: "\u200d", 0xE0AD: "-"})
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    return unicodedata.normalize("NFC", text)


def pattern_of(text: str) -> re.Pattern[str]:
    """The cheapest pattern for the words of a composed text."""
    return _ASCII_TOKEN if text.isascii() else _MARKED_TOKEN if _MARKS.search(text) else _TOKEN


class Model:
    """Character bigram scores within scripts, and the Viterbi search over look-alike lattices."""

    #: What a change of script within a word costs, and a word in another script than its document's.
    CHANGE, FOREIGN, FLOOR = 12.0, 6.0, 0.5

    def __init__(self, counts: dict[str, int]):
        from_letter: Counter[str] = Counter()
        for pair, n in counts.items():
            from_letter[pair[0]] += n
        self.score = {pair: math.log((n + self.FLOOR) / (from_letter[pair[0]] + 100)) for pair, n in counts.items()}
        self.unseen = {a: math.log(self.FLOOR / (n + 100)) for a, n in from_letter.items()}
        self.never = math.log(self.FLOOR / 100)

    def step(self, a: str, b: str) -> float:
        found = self.score.get(a + b)
        return self.unseen.get(a, self.never) if found is None else found

    def best(self, token: str, script: int) -> str:
        """The likeliest member of the class of ``token`` (given by its Latin class letters) in a document of ``script``."""
        paths: list[tuple[float, str, str, int]] = [(0.0, "", "^", script)]
        for letter in token:
            if "̀" <= letter <= "ͯ":
                paths = [(cost, said + letter, last, s) for cost, said, last, s in paths]
                continue
            options = LATTICE.get(letter) or [(letter, script_of(letter))]
            found = []
            for c, s in options:
                top = None
                for cost, said, last, was in paths:
                    total = cost + self.step(last, c) - ((self.FOREIGN if last == "^" else self.CHANGE) if s != was and s >= 0 else 0.0)
                    if top is None or total > top[0]:
                        top = (total, said + c, c, s)
                found.append(top)
            paths = found
        return max(paths, key=lambda p: p[0])[1]


class Normalizer:
    """Normalizes texts; words already searched are kept, up to a bound, for the next text."""

    BOUND = 300_000

    def __init__(self, model: Model):
        self.model = model
        self.known: list[set[str]] = [set(), set(), set()]
        self.changed: list[dict[str, str]] = [{}, {}, {}]

    @staticmethod
    def script(text: str) -> int:
        """The script of most letters that have no look-alike: the same for all texts of one look."""
        if not _OTHER_SCRIPT.search(text):
            return 0
        counts = [len(_PLAIN_LATIN.findall(text)), len(_CYRILLIC.findall(text)), len(_GREEK.findall(text))]
        return counts.index(max(counts))

    def form(self, token: str, script: int) -> str:
        """The best path through the lattice of a word in class letters."""
        parts = token if token.isascii() else unicodedata.normalize("NFD", token)
        best = self.model.best(parts, script)
        return best if best.isascii() else unicodedata.normalize("NFC", best)

    def __call__(self, text: str) -> str:
        text = fold(text)
        other = not text.isascii() and _OTHER_SCRIPT.search(text)
        if other:
            text = unicodedata.normalize("NFC", text.translate(CLASSES))
        script = self.script(text) if other else 0
        pattern = pattern_of(text)
        tokens = set(pattern.findall(text))
        known, changed = self.known[script], self.changed[script]
        if len(known) > self.BOUND:
            known.clear()
            changed.clear()
        for token in tokens - known:
            form = self.form(token, script)
            known.add(token)
            if form != token:
                changed[token] = form
        if changed and not tokens.isdisjoint(changed):
            text = pattern.sub(lambda m: changed.get(m[0], m[0]), text)
        return text


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens: Counter[str] = Counter()
    pairs: Counter[str] = Counter()

    def drain() -> None:
        for token, n in tokens.items():
            letters = [c for c in (token if token.isascii() else unicodedata.normalize("NFD", token)) if not "̀" <= c <= "ͯ"]
            scripts = {script_of(c) for c in letters}
            if len(scripts) == 1 and -1 not in scripts and all(c < "԰" for c in letters):
                last = "^"
                for c in letters:
                    pairs[last + c] += n
                    last = c
        tokens.clear()

    for batch in batches:
        for text in batch.column(0).to_pylist():
            text = fold(text)
            tokens.update(set(pattern_of(text).findall(text)))
        if len(tokens) > 200_000:
            drain()
    drain()
    yield pa.RecordBatch.from_arrays([pa.array(list(pairs), pa.string()), pa.array(list(pairs.values()), pa.int64())], ["pair", "n"])


#: Letters of the three scripts after decomposition, squared: no table of letter pairs can be larger.
PAIR_BOUND = 750_000


def train(df: DataFrame, text: str = "text") -> Model:
    """Bigram counts of the words in one script, each word once a text, over all texts.

    The table is bounded by the alphabets (PAIR_BOUND), whatever the size of the corpus.
    """
    counted = spread(df.select(F.col(f"`{text}`").alias("t")).where("t is not null")).mapInArrow(_count, "pair string, n bigint")
    rows = counted.groupBy("pair").agg(F.sum("n").alias("n")).limit(PAIR_BOUND).collect()
    return Model({r[0]: r[1] for r in rows})


def normalize(df: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None, digests: bool = False) -> DataFrame:
    """Every row's key and text in one consistent form, or, with ``digests``, 128-bit digests of both forms.

    Each text is folded (width forms, ligatures, spaces, combining accents, ignorable characters), every
    letter is replaced by its class of look-alikes, and each word is the best path through the lattice of
    its classes.  The lattice depends on the look of the text alone, so texts that look the same come out
    equal; a path only chooses among look-alikes, so texts that look different stay apart.

    A null text stays null (with ``digests``: gives no row); an empty one stays empty.  A null key is kept.
    Other columns are dropped.
    """
    model = model or train(df, text)
    shared = df.sparkSession.sparkContext.broadcast(model.__dict__)
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.__dict__.update(shared.value)
        form = Normalizer(own)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            done = [None if t is None else form(t) for t in texts]
            if digests:
                sign = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                columns = [pa.array([sign(t) if t.strip() else None for t in done], pa.binary()), pa.array([sign(t) for t in texts], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "look", "characters"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], [key, text])

    rows = spread(df.select(F.col(f"`{key}`"), F.col(f"`{text}`")))
    if digests:
        return rows.where(F.col(f"`{text}`").isNotNull()).mapInArrow(run, f"`{key}` {key_type}, look binary, characters binary")
    return rows.mapInArrow(run, f"`{key}` {key_type}, `{text}` string")


def lookalike_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Members of the classes of texts that look the same though their characters differ: key, look, characters.

    Classes all of whose texts are equal, and null, empty and blank texts, are left out.  A row that is
    repeated counts once.
    """
    signs = checkpointed(normalize(df, key, text, digests=True).where(F.col("look").isNotNull()))
    kinds = signs.groupBy("look", "characters").agg(F.count(F.lit(1)).alias("n"))
    mixed = kinds.groupBy("look").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("look")
    return signs.where(F.col(key).isNotNull()).join(mixed, "look", "left_semi").select(key, "look", "characters").distinct()


def lookalike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """Pairs of keys (``a`` < ``b``) whose texts differ in their characters but look the same."""
    members = checkpointed(lookalike_classes(df, key, text))
    left = members.select(F.col(key).alias(a), "look", F.col("characters").alias("ca"))
    right = members.select(F.col(key).alias(b), "look", F.col("characters").alias("cb"))
    return left.join(right, "look").where((F.col(a) < F.col(b)) & (F.col("ca") != F.col("cb"))).select(a, b).distinct()
