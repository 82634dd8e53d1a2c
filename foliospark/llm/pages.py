"""Furniture of pages: page numbers and running heads by trained features of their place on the page."""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass, field

from foliospark.llm.perceptron import Perceptron

# Up to 399: larger ones are hardly page numbers, and words such as "mix" are.
_ROMAN = r"(?:c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))"
#: A number with something around it: dashes, brackets, a total, a letter, or a word and perhaps a word and the total.
_DRESSED = r"(?:[-–—] ?\d{1,4} ?[-–—]|\[\d{1,4}\]|\d{1,4}/\d{1,4}|[^\W\d_]\. ?\d{1,4}|[^\W\d_]{3,12} \d{1,4}(?: [^\W\d_]{2,4} \d{1,4})?)"
_ANY = rf"(?:{_DRESSED}|\d{{1,4}}|(?=[clxvi]){_ROMAN})"
_ALONE = re.compile(_ANY)
_BEFORE = re.compile(rf"({_ANY})(?: {{2,}}|\t+| \| )(.+)")
_AFTER = re.compile(rf"(.+?)(?: {{2,}}|\t+| \| )({_ANY})")
PARTS = re.compile(r" {2,}|\t+| \| ")
ENDED = re.compile(r"[.!?;:…。！？][\"')\]”’»]*$")
_STOP = re.compile(r"(\S*)\. ")
_WORDED = re.compile(r"([^\W\d_]{3,12}) \d{1,4}(?: [^\W\d_]{2,4} \d{1,4})?")
_LONG_WORD = re.compile(r"[^\W\d_]{4,}")
_DIGIT = re.compile(r"\d")


def short_form(word: str) -> bool:
    """Whether a word before a full stop looks like an abbreviation: short, with a capital."""
    return 0 < len(word) < 5 and word[0].isupper()


def head_parts(line: str) -> list[str]:
    """What identifies a running head: its parts' words in lower case; none if the line can't be one."""
    if not (line[0].isupper() or line[0].isdigit()) or line[-1] in "!?;:…。！？,-" or ", " in line or ": " in line or "; " in line or "..." in line or len(_DIGIT.findall(line)) > 4:
        return []
    pieces = [p for p in PARTS.split(line) if p] if "  " in line or "\t" in line or " | " in line else [line]
    for p in pieces:
        if p[-1] == "." and len(p.rsplit(" ", 1)[-1]) > 5 or ". " in p and any(not short_form(m[1]) for m in _STOP.finditer(p)) or "! " in p or "? " in p:
            return []
    parts = [p.split() for p in pieces]
    if not any(len(w) > 1 and sum(map(len, w)) > 5 for w in parts) or len(parts) > 2 and any(len(w) == 1 for w in parts):
        return []
    return [" ".join(w).lower() for w in parts if len(w) > 1]


def number_word(line: str) -> str | None:
    """The word of a line that is a word and a number alone."""
    m = _WORDED.fullmatch(line)
    return m[1].lower() if m else None


@dataclass
class Line:
    """A line of a page that may be furniture: its place, its parts or number, and its features."""

    at: int
    text: str
    parts: tuple[str, ...] = ()
    number: str | None = None
    alone: bool = False
    features: list[tuple] = field(default_factory=list)
    score: float = 0.0
    shown: bool = False
    first: bool = False


def year_like(number: str) -> bool:
    """Whether a bare number may be a year."""
    return len(number) == 4 and number[0] in "12" and 1500 <= int(number) <= 2100


def styled(line: str) -> bool:
    """Whether a line is set in capitals, or with capitals on all longer words."""
    longer = _LONG_WORD.findall(line)
    return bool(longer) and all(w[0].isupper() for w in longer)


def kind_of(number: str, words: Mapping[str, int]) -> str:
    """bare, year, roman, dressed or worded, the last with how often its word stands beside a number alone."""
    if number.isdigit():
        return "year" if year_like(number) else "bare"
    word = number_word(number)
    return f"worded {words.get(word, 0)}" if word else "roman" if number.isalpha() else "dressed"


def lines_of(text: str) -> list[str]:
    """The lines of a text, page ends as lines of their own."""
    return text.replace("\x0c", "\n\x0c\n").split("\n")


def candidates(lines: list[str], words: Mapping[str, int]) -> list[Line]:
    """Lines that may be furniture, with their features."""
    found: list[Line] = []
    for i, raw in enumerate(lines):
        line = raw.strip()
        if not line or line == "\x0c":
            continue
        c = line[0]
        if not (c.isupper() or c.isdigit() or c in "-–—[pclxvi"):
            continue
        if len(line) < 32 and _ALONE.fullmatch(line) and (c.isupper() or number_word(line) is None):
            found.append(Line(i, line, number=line, alone=True))
            continue
        number = rest = None
        if "  " in line or "\t" in line or " | " in line:
            if m := _BEFORE.fullmatch(line):
                number, rest = m[1], m[2]
            elif m := _AFTER.fullmatch(line):
                rest, number = m[1], m[2]
        parts = head_parts((rest or line).strip())
        if not parts:
            continue
        if number and len((rest or "").split()) < 2:
            number = None
        found.append(Line(i, line, tuple(parts), number))
    if not found:
        return []
    repeated = Counter(p for x in found for p in set(x.parts))
    beside_of: dict[tuple[str, ...], set[str]] = {}
    for x in found:
        if x.number and x.parts:
            beside_of.setdefault(x.parts, set()).add(x.number)
    for x in found:  # what never changes beside a repeated head, or has an unknown word, is a part of the head
        if x.number and x.parts and (len(beside_of[x.parts]) == 1 and repeated[x.parts[0]] > 1 or kind_of(x.number, words) == "worded 0"):
            x.number = None
    lengths = sorted(len(x) for x in lines if x.strip())
    full = 0.6 * lengths[len(lengths) * 9 // 10]
    at_lines = {x.at: x for x in found}
    at_numbers = {x.at for x in found if x.number}
    numbers = [x for x in found if x.alone and x.number.isdigit()]
    runs = {x.at for a, b in zip(numbers, numbers[1:]) if 0 < int(b.number) - int(a.number) <= 2 for x in (a, b)}

    def near(i: int, step: int) -> int | None:
        j = i + step
        while 0 <= j < len(lines) and not lines[j].strip(" \t\r"):
            j += step
        return j if 0 <= j < len(lines) else None

    def tabular(j: int | None) -> bool:
        return j is not None and j not in at_numbers and bool(PARTS.search(lines[j].strip()) or _DIGIT.search(lines[j][-3:]))

    for x in found:
        before, after = near(x.at, -1), near(x.at, 1)
        end = any(j is None or "\x0c" in lines[j] for j in (before, after))
        beside_number = any(j in at_lines and at_lines[j].alone for j in (before, after))
        edge = end or beside_number
        # Content around the line, beyond other furniture.
        up, down = before, after
        for _ in range(4):
            if up is not None and ("\x0c" in lines[up] or up in at_lines):
                up = near(up, -1)
            if down is not None and ("\x0c" in lines[down] or down in at_lines):
                down = near(down, 1)
        cut = up is not None and down is not None and not ENDED.search(lines[up].strip()) and lines[down].strip()[:1].islower() and len(lines[up].strip()) >= full and not PARTS.search(lines[up].strip())
        if x.alone:
            kind = kind_of(x.number, words)
            x.features = [("number", kind, end, cut), ("number by a number", kind.split()[0], beside_number, end), ("number in a run", kind, x.at in runs), ("number", kind), ("number in a table", kind.split()[0], tabular(before) and tabular(after)), ("long roman", kind == "roman" and len(x.number) > 2, end or cut)]
            x.shown = True
            continue
        times = max(repeated[p] for p in x.parts)
        beside = x.number is not None
        gap = after is not None and after > x.at + 1 and not edge and not cut
        x.shown, x.first = edge or cut or times > 1 or beside, before is None
        x.features = [
            ("head",), ("head times", min(times, 4)), ("head times", min(times, 4), edge, cut), ("head beside", beside and kind_of(x.number, words).split()[0], times > 1), ("head edge", edge, beside),
            ("head cut", cut, styled(x.text), times > 1), ("head stop", "." in x.text[-1:], times > 1, beside), ("head of a table", not edge and not beside and tabular(after), times > 1), ("head gap", gap, times > 1), ("head first", before is None, times > 1, beside), ("head place", edge, cut, gap, beside, styled(x.text)),
        ]
    return found


def shared_features(elsewhere: int, bundle: int, first: bool) -> list[tuple]:
    """What other texts say of a head: in how many it is one for sure, and in how many of its bundle it stands where heads do."""
    return [("head elsewhere", min(elsewhere, 2), first), ("head in bundle", min(bundle, 4), first), ("head known", elsewhere > 0, bundle > 2)]


@dataclass
class Pages:
    """Tells furniture from content by a perceptron over the features of a line's place."""

    perceptron: Perceptron = field(default_factory=Perceptron)
    words: dict[str, int] = field(default_factory=dict)

    def __call__(self, text: str) -> list[Line]:
        """The lines of a canonical text that may be furniture, scored; from above 0 they are."""
        found = candidates(lines_of(text), self.words)
        for x in found:
            x.score = self.perceptron.score(x.features) - MARGIN
        return found


#: What a line's features must weigh more than to be furniture.
MARGIN = 0.5
#: Texts that the page model is trained on, at most.
TRAINING_PAGES = 1_500


def trained(texts: list[str], words: Mapping[str, int], passes: int = 6) -> Pages:
    """A page model trained on furniture planted in texts that show none, and on what they hold that looks like it.

    ``texts`` are canonical, at most TRAINING_PAGES; ``words`` is what ``kind_of`` takes.
    """
    rnd, pages = random.Random(3), Pages(words=dict(words))
    clean: list[list[str]] = []
    titles: list[str] = []
    cells: list[str] = []
    for text in texts[:TRAINING_PAGES]:
        lines = lines_of(text)
        found = candidates(lines, words)
        titles += [x.text for x in found if x.parts and not x.number and x.at == 0]
        cells += [p for line in lines for p in PARTS.split(line.strip())[1:] if p.isdigit() and len(p) < 5]
        times = Counter(p for x in found for p in set(x.parts))
        if len(lines) > 5 and "\x0c" not in text and not any(x.alone or x.number for x in found) and max(times.values(), default=0) < 2:
            clean.append(lines)
    named = [w.capitalize() for w, n in words.items() if n >= 3] or ["Page"]
    titles, cells = titles or ["A Head of Pages", "ANOTHER HEAD"], cells or [str(n) for n in range(1, 2000, 7)]

    def number(style: int, n: int, last: int, word: str) -> str:
        roman = "".join(v * (n // k % m) for k, m, v in ((10, 10, "x"),)) + ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"][n % 10]
        return [str(n), f"- {n} -", f"[{n}]", f"p. {n}", f"{n}/{last}", roman or str(n), f"{word} {n}", f"{word} {n} of {last}", str(n), f"— {n} —"][style]

    samples: list[tuple[list[list[tuple]], int]] = []
    for lines in clean:
        for turn in range(2):
            page, shared = [(line, 0) for line in lines], False
            head = rnd.choice(titles)
            head = head.upper() if rnd.random() < 0.3 else head
            kind = rnd.choice(("head", "number", "both", "beside", "none", "table", "section", "stamp"))
            style, n, word, places = rnd.randrange(10), rnd.randrange(1, 400) if rnd.random() < 0.9 else rnd.randrange(1500, 2100), rnd.choice(named), rnd.choice((1, 1, 2, 3, 4))
            n = n % 39 + 1 if style == 5 else n
            if kind in ("head", "number", "both", "beside"):
                spots = sorted(rnd.sample(range(1, len(lines)), min(places, len(lines) - 1)), reverse=True)
                if rnd.random() < 0.3:
                    spots = [len(lines), *spots]
                if rnd.random() < 0.4:
                    spots.append(0)
                shared = rnd.random() < 0.6
                if kind == "head" and shared and rnd.random() < 0.5:
                    spots = [rnd.choice((0, len(lines)))]  # shown by other texts alone
                ends = rnd.random() < 0.4
                for k, at in enumerate(spots):
                    own = n + len(spots) - k
                    said = number(style, own, own + 40, word)
                    gap = rnd.choice(("  ", "   ", "\t", " | "))
                    block = {"head": [head], "number": [said], "both": rnd.sample([head, said], 2), "beside": [head + gap + said if k % 2 else said + gap + head]}[kind]
                    block = [(b, 1) for b in block]
                    if ends and 0 < at < len(lines):
                        block.insert(rnd.randrange(len(block) + 1), ("\x0c", 0))
                    page[at:at] = block
            elif kind == "table" and rnd.random() < 0.5:  # the head of a table that is repeated
                top = " ".join(w.capitalize() for w in rnd.choice(titles).split()[: rnd.randrange(2, 6)])
                for at in sorted(rnd.sample(range(1, len(lines)), min(2, len(lines) - 1)), reverse=True):
                    page[at:at] = [(top, 0), *((f"{rnd.choice(titles).split()[0].capitalize()} {' '.join(rnd.choices(cells, k=rnd.randrange(1, 4)))}", 0) for _ in range(3))]
            elif kind == "table":
                at = rnd.randrange(1, len(lines))
                rows = [(rnd.choice((rnd.choice(cells), f"row  {rnd.choice(cells)}  {rnd.choice(cells)}", f"{rnd.choice(titles).split()[0].capitalize()} {rnd.choice(cells)}")), 0) for _ in range(rnd.randrange(2, 6))]
                page[at:at] = [("column  first  second", 0), *rows, ("sum  12  34", 0)]
                if rnd.random() < 0.5:  # a year on a line of its own, within a paragraph
                    page.insert(rnd.randrange(1, len(lines)), (str(rnd.randrange(1890, 2020)), 0))
            elif kind == "stamp":  # a line at the page's end or start that nothing else speaks for
                page.insert(rnd.choice((0, len(page), len(page))), (rnd.choice((head, " ".join(head.split()[:2]).title())), 0))
            elif kind == "section":
                blanks = [i for i in range(1, len(lines) - 1) if not lines[i].strip()] or [1]
                at = rnd.choice(blanks)
                page[at + 1 : at + 1] = [(head, 0), *([("", 0)] if rnd.random() < 0.5 else [])]
            labels = [label for _, label in page]
            for x in candidates([line for line, _ in page], words):
                features = list(x.features)
                right = labels[x.at]
                if x.parts:
                    known = shared if right else rnd.random() < 0.02
                    features += shared_features(rnd.randrange(1, 4), rnd.randrange(0, 6), x.first) if known else shared_features(0, rnd.choice((0, 0, 1)), x.first)
                samples.append(([[], features], right))
    pages.perceptron.train(samples, passes)
    return pages
