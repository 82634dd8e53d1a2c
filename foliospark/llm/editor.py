"""The character editor: what misreadings made of words, and what line ends made of them."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from foliospark.llm.perceptron import Perceptron

#: Words that the editor is trained on, at most, and passes over them.
TRAINING_WORDS, PASSES = 3_000, 8
#: Texts that must hold a word for it to be what was printed, and how many times more than the misread one.
PRINTED, RATIO = 8, 8
#: What share of all words that show confusions must show one for it to be looked for where no printed word is one step
#: away, and how many of them at least.
SURE_SHARE, SURE = 0.0025, 3

ODD = re.compile(r"[0-9!(]")
_MIXED = re.compile(r"(?=.*[^\W\d_])(?=.*[0-9!(])")


def bucket(count: float) -> int:
    return int(math.log2(count + 1))


def regions(word: str) -> Iterator[tuple[int, int, str]]:
    """Regions of one or two characters with what stands around them, as (start, size, pattern)."""
    for at in range(len(word)):
        for size in (1, 2):
            if at + size <= len(word) and len(word) - size >= 2:
                yield at, size, f"{word[:at]}\0{word[at + size:]}"


@dataclass(frozen=True)
class Edit:
    """Characters of a word from ``at`` on that are read as ``noisy`` where ``clean`` was printed."""

    at: int
    noisy: str
    clean: str

    @property
    def operations(self) -> tuple[str, ...]:
        """Operations by character: replace, then delete what is too many or insert what is missing."""
        shared = min(len(self.noisy), len(self.clean))
        return ("replace",) * shared + ("delete",) * (len(self.noisy) - shared) + ("insert",) * (len(self.clean) - shared)


def between(word: str, printed: str) -> Edit | None:
    """The one edit of up to two characters that makes ``printed`` of ``word``: 1 to 1, 1 to 2 or 2 to 1."""
    a = 0
    while a < min(len(word), len(printed)) and word[a] == printed[a]:
        a += 1
    b = 0
    while b < min(len(word), len(printed)) - a and word[-1 - b] == printed[-1 - b]:
        b += 1
    noisy, clean = word[a : len(word) - b], printed[a : len(printed) - b]
    if not noisy or not clean:  # a repeated letter: take its neighbour in
        if a:
            a -= 1
        else:
            b -= 1
        noisy, clean = word[a : len(word) - max(b, 0)], printed[a : len(printed) - max(b, 0)]
    return Edit(a, noisy, clean) if noisy != clean and (len(noisy), len(clean)) in ((1, 1), (1, 2), (2, 1)) else None


@dataclass
class Editor:
    """Scores keeping a word against what one or two edits make of it, and the operations at a line end.

    ``channel`` holds how many words show each confusion (noisy, clean); the perceptron's weights say what that,
    the counts and the places are worth.  Without weights nothing is changed.
    """

    channel: dict[tuple[str, str], int] = field(default_factory=dict)
    perceptron: Perceptron = field(default_factory=Perceptron)

    def __post_init__(self) -> None:
        self.sure: dict[str, list[str]] = defaultdict(list)
        self.least = max(SURE, SURE_SHARE * sum(self.channel.values()))
        for (noisy, clean), n in sorted(self.channel.items()):
            if n >= self.least:
                self.sure[noisy].append(clean)

    # ---- Words ----

    def keep(self, word: str, count: int) -> list[tuple]:
        odd = bool(ODD.search(word))
        return [("keep",), ("keep odd", odd), ("keep long", odd, min(len(word), 7)), *(("keep from", k) for k in range(min(bucket(count), 10)))]

    def change(self, word: str, count: int, edits: tuple[Edit, ...], known: int) -> list[tuple]:
        ratio = math.log10((known + 1) / (count + 1))
        out: list[tuple] = [("edits", len(edits), min(len(word), 8), known > 0), *(("printed from", len(edits), k) for k in range(min(bucket(known), 12))), *(("ratio from", k) for k in range(10) if ratio >= k / 3)]
        for e in edits:
            odd = bool(ODD.search(e.noisy))
            seen = min(bucket(self.channel.get((e.noisy, e.clean), 0)), 7)
            before, after = word[e.at - 1 : e.at], word[e.at + len(e.noisy) : e.at + len(e.noisy) + 1]
            end = "first" if e.at == 0 else "last" if e.at + len(e.noisy) == len(word) else "inner"
            out += [(op, known > 0) for op in e.operations]
            out += [("pair", e.noisy, e.clean), ("sides", odd, before.isalpha(), after.isalpha(), known > 0), ("end", end, odd, known > 0), ("unseen", seen == 0, end, min(len(word), 7)), ("unseen often", seen < 2, min(bucket(count), 4)), *(("seen from", k, odd, known > 0) for k in range(1, seen + 1))]
            if known == 0:
                out.append(("unknown", odd, e.clean.isalpha(), end, min(bucket(count), 3)))
        return out

    def guesses(self, word: str) -> Iterator[tuple[str, tuple[Edit, ...]]]:
        """What sure confusions make of a word for which no printed one is a step away: two edits, or one where a digit or mark stands among letters."""
        single = [Edit(at, word[at : at + z], clean) for at, z, _ in regions(word) for clean in self.sure.get(word[at : at + z], ())]
        for e in single:
            made = word[: e.at] + e.clean + word[e.at + len(e.noisy) :]
            if len(word) >= 5 and ODD.search(e.noisy) and made.isalpha() and 0 < e.at < len(word) - len(e.noisy):
                yield made, (e,)
            if len(word) >= 5:
                for other in single:
                    if other.at >= e.at + len(e.noisy):
                        shifted = other.at + len(e.clean) - len(e.noisy)
                        yield made[:shifted] + other.clean + made[shifted + len(other.noisy) :], (e, other)

    def gain(self, word: str, count: int, edits: tuple[Edit, ...], known: int) -> float:
        """How much more a change scores than keeping the word; positive if the change is made."""
        return self.perceptron.score(self.change(word, count, edits, known)) - self.perceptron.score(self.keep(word, count))

    # ---- Line ends ----

    OPERATIONS = ("apart", "compound", "join")

    def line_end(self, b: Break, count: Mapping[str, int] | Callable[[str], int]) -> list[list[tuple]]:
        """Features of leaving two parts of a line end apart, joining them with the mark, and joining them without."""
        n = count if callable(count) else lambda w: count.get(w, 0)
        joined, compound, left, right, hanging = (n(k) for k in b.keys)
        between = lambda x, y: max(-8, min(8, round(math.log2((x + 1) / (y + 1)))))
        facts = [
            ("joined to compound", between(joined, compound), joined > 0, compound > 0), ("hanging to joined", between(hanging, joined), hanging > 0), ("joined", min(bucket(joined), 8)), ("compound", min(bucket(compound), 6)),
            ("parts", left > 5 and len(b.left) > 2, right > 5 and len(b.right) > 2, joined > 0, compound > 0), ("short", len(b.left) == 1, len(b.right) < 3, joined > 0), ("soft", b.soft, b.chained),
            ("code", b.code, joined > 0), ("chained", b.chained, joined > 0), ("capital", b.left.isupper(), len(b.left) < 5, joined > 0),
        ]
        return [[("line end", op, *f) for f in facts] for op in self.OPERATIONS]

    def at_line_end(self, b: Break, count: Mapping[str, int] | Callable[[str], int]) -> str:
        """The operation at a line end: apart, compound or join."""
        return self.OPERATIONS[self.perceptron.choose(self.line_end(b, count))]


@dataclass(frozen=True)
class Break:
    """The parts of a word at a line end: before the mark and after it; a mark that no compound has; a part of a chain of marks; beside digits."""

    left: str
    right: str
    soft: bool = False
    chained: bool = False
    code: bool = False

    @property
    def keys(self) -> tuple[str, str, str, str, str]:
        """The words whose counts decide: joined, compound, both parts, and the right part after a hanging hyphen."""
        a, b = self.left.lower(), self.right.lower()
        return a + b, f"{a}-{b}", a, b, f"- {b}"


# ---- Training --------------------------------------------------------------------------------------------


def _key(word: str) -> bytes:
    return hashlib.md5(word.encode()).digest()


def noise_channel(pairs: Iterator[tuple[str, int, str, int]] | list[tuple[str, int, str, int]]) -> dict[tuple[str, str], int]:
    """How many words show each confusion, from words and the printed ones a step away (word, count, printed, its count)."""
    best: dict[str, tuple[int, Edit]] = {}
    for word, n, printed, known in pairs:
        if known >= RATIO * max(n, 1) and (e := between(word, printed)):
            best[word] = max(best.get(word, (0, e)), (known, e), key=lambda x: x[0])
    return dict(Counter((e.noisy, e.clean) for _, e in best.values()))


def trained(words: Mapping[str, int], pairs: list[tuple[str, int, str, int]], channel: dict[tuple[str, str], int], size: int = TRAINING_WORDS, passes: int = PASSES) -> Editor:
    """An editor trained on noise put into words of a sample, and on real words that stay.

    ``words`` are counted words (a sample in which training words are chosen by hash, at most ``size`` of them);
    ``pairs`` are words with a printed one a step away.  Noise is drawn from the channel, and from the statistics
    of characters alone, so that confusions that no word of the corpus shows are learned too.  Words that occur far
    more often than misreading would make them, codes, and made-up names stay what they are.
    """
    editor, rnd = Editor(dict(channel)), random.Random(7)
    plain = sorted((w for w, n in words.items() if n >= 2 * PRINTED and w.isalpha() and len(w) > 2), key=_key)[:size]
    if not plain:
        return editor
    letters = [c for w in plain for c in w]
    twos = [w[i : i + 2] for w in plain for i in range(len(w) - 1)] or letters
    by_clean: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for (noisy, clean), n in sorted(channel.items()):
        if n >= 2:
            by_clean[clean].append((noisy, n))
    samples: list[tuple[list[list[tuple]], int]] = []

    def misread(word: str, listed: bool) -> str | None:
        places = [(i, word[i : i + z]) for i in range(len(word)) for z in (1, 2) if i + z <= len(word) and (not listed or word[i : i + z] in by_clean)]
        if not places:
            return None
        i, clean = rnd.choice(places)
        if listed:
            options = by_clean[clean]
            noisy = rnd.choices([o for o, _ in options], [n for _, n in options])[0]
        else:
            noisy = rnd.choice(letters) if len(clean) == 2 or rnd.random() < 0.7 else rnd.choice(twos)
        made = word[:i] + noisy + word[i + len(clean) :]
        return made if made != word and between(made, word) else None

    for w in plain:
        n = words[w]
        samples.append(([editor.keep(w, n)], 0))
        for listed in (True, True, False):
            made = misread(w, listed)
            if made is None or words.get(made, 0) > 0.05 * n:
                continue
            count = rnd.choice((1, 1, 1, 2, 3, max(1, int(n * 0.01)), max(1, int(n * 0.003))) if listed else (1, 1, 2))
            if not listed and rnd.random() < 0.3:  # a word of its own: no misreading that no other word shows occurs so often
                count = rnd.randrange(4, 20)
            if n < RATIO * count:
                continue
            edit = between(made, w)
            # A word that differs from a rare one in any way is rather a name of its own; so are very short ones.
            right = 1 if listed or n >= 12 * PRINTED and len(w) > 5 and count < 4 else 0
            samples.append(([editor.keep(made, count), editor.change(made, count, (edit,), n)], right))
            again = misread(made, True) if listed and len(made) > 5 else None
            edits = next((e for r, e in editor.guesses(again) if r == w and len(e) == 2), None) if again else None
            if edits:
                samples.append(([editor.keep(again, 1), editor.change(again, 1, edits, n)], 1))
            if listed and ODD.search(made) and edit.at and made[:1].isalpha():
                samples.append(([editor.keep(made, 1), editor.change(made, 1, (edit,), 0)], 1))  # in a name that no other text has
            elif listed:
                samples.append(([editor.keep(made, 1), editor.change(made, 1, (edit,), 0)], 0))
    # Misreading makes so many of a word's occurrences at most; what occurs far more often is a word of its own.
    shares = sorted(n / known for word, n, printed, known in pairs if (e := between(word, printed)) and known >= 12 * PRINTED and channel.get((e.noisy, e.clean), 0) >= editor.least)
    most = shares[len(shares) * 98 // 100] if shares else 0.03
    for word, n, printed, known in pairs:
        if n >= 5 and n > 1.5 * most * known and (e := between(word, printed)):
            samples.append(([editor.keep(word, n), editor.change(word, n, (e,), known)], 0))
    for w in sorted((w for w, n in words.items() if PRINTED <= n < 12 * PRINTED and w.isalpha() and len(w) > 3), key=_key)[:size]:
        made = misread(w, False)
        if made and not words.get(made, 0) and not channel.get((between(made, w).noisy, between(made, w).clean), 0) >= 2:
            samples.append(([editor.keep(made, 1), editor.change(made, 1, (between(made, w),), words[w])], 0))
    near = {word for word, _, _, _ in pairs}
    for w in sorted((w for w, n in words.items() if n >= 5 and w not in near and _MIXED.match(w)), key=_key)[:size]:
        for result, edits in editor.guesses(w):
            if len(edits) == 1 and words.get(result, 0) < RATIO * words[w]:
                samples.append(([editor.keep(w, words[w]), editor.change(w, words[w], edits, words.get(result, 0))], 0))
    samples += _line_ends(editor, words, plain, size)
    editor.perceptron.train(samples, passes)
    return editor


def _line_ends(editor: Editor, words: Mapping[str, int], plain: list[str], size: int) -> list[tuple[list[list[tuple]], int]]:
    """Words broken at any place, compounds broken at their own hyphen, hanging hyphens and codes."""
    rnd, samples = random.Random(11), []
    compounds = sorted((w for w in words if w.count("-") == 1 and w[0] != "-" and w[-1] != "-" and " " not in w), key=_key)[:size]
    hanging = sorted((w for w in words if w.startswith("- ") and words[w] >= 2), key=_key)[:size]

    # Counting joins what it meets at line ends; such joins of compounds and hanging hyphens are no words.
    flat = {w.replace("-", "") for w in words if "-" in w and " " not in w and words[w] > words.get(w.replace("-", ""), 0)}
    hung = {w[2:] for w in hanging}
    plain = [w for w in plain if w not in flat and not any(w[cut:] in hung and words[f"- {w[cut:]}"] > words[w] for cut in range(1, len(w)))]

    def add(b: Break, right: str, hidden: tuple[str, ...] = (), seen: Mapping[str, int] | None = None) -> None:
        count = lambda w: (seen or {}).get(w, 0) or (0 if w in hidden else words.get(w, 0))
        samples.append((editor.line_end(b, count), editor.OPERATIONS.index(right)))

    def shape(text: str) -> str:
        return text.upper() if rnd.random() < 0.06 else text

    for w in plain:
        for hide in (False, False, True):
            cut = rnd.randrange(1, len(w))
            a, b = w[:cut], w[cut:]
            if rnd.random() < 0.06:
                a, b = a.upper(), b.upper()
            soft = rnd.random() < 0.3
            add(Break(a, b, soft), "join", *(((w,), {w: rnd.choice((0, 1, 1, 2, 3, 6))}) if hide and (len(a) > 1 or len(b) > 2) else ()))
        for cut in range(3, len(w) - 2):  # words made of two
            if words.get(w[:cut], 0) > 5 and words.get(w[cut:], 0) > 5:
                for _ in range(4):
                    add(Break(w[:cut], w[cut:]), "join")
    for w in compounds:
        a, b = w.split("-")
        if a.isalpha() and b.isalpha():
            add(Break(a, b), "compound")
            if words.get(a, 0) > 5 and words.get(b, 0) > 5 and len(a) > 2 and len(b) > 2:
                add(Break(a, b), "compound", (w, a + b), {a + b: rnd.choice((0, 1, 1, 2))})
            if len(hanging) > 1 and rnd.random() < 0.3:
                add(Break(a, rnd.choice(hanging)[2:]), "apart")
    for w in plain[: len(plain) // 2]:
        v = rnd.choice(plain)
        if words.get(w + v, 0) == 0 and len(w) > 3 and len(v) > 3:
            add(Break(w, v), "compound", seen={w + v: rnd.choice((0, 1, 1, 2))})
        a, b = "".join(rnd.choices("ABCDEFGHJKLMRTXZ", k=rnd.randrange(1, 5))), "".join(rnd.choices("ABCDEFGHJKLMRTXZ", k=rnd.randrange(1, 4)))
        add(Break(a, b, code=rnd.random() < 0.7), "compound")
        add(Break(rnd.choice(plain), w, chained=True), "compound")
    lefts = [w.split("-")[0] for w in compounds] or plain
    for w in hanging:
        for _ in range(3 + 4 * bucket(words[w])):
            a = rnd.choice(rnd.choice((plain, lefts)))
            # Counting joins what it meets at line ends, so these joins have been seen as well.
            add(Break(a, w[2:]), "apart", seen={a + w[2:]: rnd.choice((0, 1, 5, 25, 100))})
    return samples


# ---- A small lexicon in memory -----------------------------------------------------------------------------


@dataclass
class Lexicon:
    """Counted words with an index of what is a step away: for training samples and tests."""

    words: dict[str, int]

    def __post_init__(self) -> None:
        self.near: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for w, n in self.words.items():
            if n >= PRINTED and w.isalpha():
                for _, size, pattern in regions(w):
                    self.near[pattern].append((w, size))

    def printed(self, word: str, count: int) -> list[str]:
        """Printed words a step away from ``word``."""
        found = {w for _, size, pattern in regions(word) for w, other in self.near.get(pattern, ()) if size + other < 4 and w != word}
        return sorted(w for w in found if self.words[w] >= RATIO * max(count, 1) and between(word, w))

    def pairs(self) -> list[tuple[str, int, str, int]]:
        return [(w, n, p, self.words[p]) for w, n in sorted(self.words.items()) if len(w) > 2 and " " not in w and "-" not in w for p in self.printed(w, n)]

    def editor(self, **options) -> Editor:
        pairs = self.pairs()
        return trained(self.words, pairs, noise_channel(pairs), **options)

    def restored(self, editor: Editor, word: str) -> str:
        """The word as printed."""
        count = max(self.words.get(word, 0), 1)
        options = [(editor.gain(word, count, (between(word, p),), self.words[p]), p) for p in self.printed(word, count)]
        if not options:
            options = [(editor.gain(word, count, edits, self.words.get(made, 0)), made) for made, edits in editor.guesses(word) if len(edits) == 1 or self.words.get(made, 0) >= RATIO * count]
        gain, best = max(options, default=(0.0, word))
        return best if gain > 0 else word
