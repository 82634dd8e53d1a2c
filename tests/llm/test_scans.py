"""Scanning noise: the editor on held-out words, line ends, page furniture, and whole texts with planted noise."""

import random

import pytest

from foliospark.llm import editor as ed
from foliospark.llm import pages as pg
from foliospark.llm import scans
from foliospark.llm.editor import Break, Edit, Editor, between
from foliospark.llm.perceptron import Perceptron

VOCABULARY = """
the that this their report shows pressure near applicant during although temperature window calibration establishes complete festival
drought estimated engineer council museum chairman committee instrument harvest machine telegram garden hospital district building river
mountain language question answer morning evening summer winter spring autumn company market product service customer supplier contract
payment account balance number letter journal article chapter sentence paragraph picture table figure column corner border circle square
signal orchard livestock reservoir pension membrane envelope curriculum theater fishery glacier timber solvent textbook tribunal footnote
""".split()
COMPOUNDS = ["short-term", "second-hand", "low-cost", "two-thirds", "cross-border", "long-term", "full-scale", "well-known"]
CONFUSED = [("e", "c"), ("h", "b"), ("m", "rn"), ("l", "1"), ("o", "0"), ("s", "5"), ("t", "f"), ("n", "ri"), ("d", "cl"), ("c", "("), ("i", "!")]
UNHEARD = [("u", "n"), ("r", "v"), ("a", "e"), ("p", "q"), ("m", "w"), ("g", "y"), ("v", "r"), ("n", "u"), ("m", "nn"), ("e", "o")]
HEADS = ["EARLIER FIGURE OF ILOBRI", "Structural Report of Quel Bros.", "Common Margin Of Norlum Quay", "Medical Newspaper For Urmar"]


def misread(word, rnd, confusions=CONFUSED):
    places = [(i, c, n) for c, n in confusions for i in range(len(word)) if word.startswith(c, i)]
    if not places:
        return None
    i, c, n = rnd.choice(places)
    return word[:i] + n + word[i + len(c) :]


def sentence(rnd):
    words = rnd.choices(VOCABULARY + COMPOUNDS, k=rnd.randrange(6, 14))
    if rnd.random() < 0.1:
        words[3:5] = ["short-", rnd.choice(["and", "or"]), "long-term"]
    return (" ".join(words) + ".").capitalize()


def page(rnd, noise=(), head=None):
    """A printed page with noise: its text, its clean paragraphs, and the kinds of noise in it."""
    clean = [" ".join(sentence(rnd) for _ in range(rnd.randrange(2, 5))) for _ in range(3)]
    kinds, lines, number = set(), [], rnd.randrange(2, 300)
    for paragraph in clean:
        line = ""
        for word in paragraph.split():
            if "glyph" in noise and rnd.random() < 0.08 and word.isalpha() and word[0].islower() and len(word) > 4 and (said := misread(word, rnd)) and not said.startswith("("):
                word = said
                kinds.add("glyph")
            if len(line) + len(word) > 44:
                if "hyphen" in noise and word.isalpha() and word[0].islower() and len(word) > 5 and rnd.random() < 0.5:
                    cut = rnd.randrange(2, len(word) - 2)
                    lines.append(f"{line} {word[:cut]}-")
                    line = word[cut:]
                    kinds.add("hyphen")
                    continue
                if word in COMPOUNDS and rnd.random() < 0.5:
                    a, b = word.split("-")
                    lines.append(f"{line} {a}-")
                    line = b
                    continue
                lines.append(line)
                line = ""
            line = f"{line} {word}".strip()
        lines += [line, ""]
    inner = [i for i in range(2, len(lines) - 2) if lines[i] and lines[i - 1] and lines[i - 1][-1] not in ".-" and lines[i][0].islower()]
    for i in sorted(rnd.sample(inner, min(2, len(inner))), reverse=True):
        block = [str(number + i)] * ("pageno" in noise) + [head] * (head is not None)
        kinds |= ({"pageno"} if "pageno" in noise else set()) | ({"header"} if head else set())
        lines[i:i] = block
    return "\n".join(lines).strip(), clean, kinds


def corpus(n, seed=4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        noise = [k for k in ("glyph", "hyphen", "pageno") if rnd.random() < 0.3]
        rows.append((i, f"b{i % 20}", *page(rnd, noise, rnd.choice(HEADS) if rnd.random() < 0.2 else None)))
    return rows


@pytest.fixture(scope="module")
def local():
    from collections import Counter

    rnd = random.Random(1)
    words = Counter({w: rnd.randrange(400, 4000) for w in VOCABULARY})
    for w in VOCABULARY:
        for _ in range(6):
            if len(w) > 3 and (said := misread(w, rnd)):
                words[said] += 1
    words.update({w: rnd.randrange(60, 400) for w in COMPOUNDS} | {p: 300 for w in COMPOUNDS for p in w.split("-")})
    words.update({"cost": 900, "cast": 800, "h2o": 40, "mp4": 30, "ilobri": 3, "- and": 60, "- or": 30, "and": 4000, "or": 3000, "# page": 40, "~ page": 20, "page": 90})
    return scans.Local.of(dict(words), [scans.canonical(t) for _, _, t, _, _ in corpus(300)])


def test_one_edit_between_words():
    assert between("rnan", "man") == Edit(0, "rn", "m") and between("tbe", "the") == Edit(1, "b", "h") and between("dosed", "closed") == Edit(0, "d", "cl")
    assert between("leter", "letter") == Edit(1, "e", "et") or between("leter", "letter").clean in ("et", "tt")
    assert between("same", "same") is None and between("abcd", "wxyz") is None
    assert Edit(0, "rn", "m").operations == ("replace", "delete") and Edit(0, "d", "cl").operations == ("replace", "insert")


def test_held_out_words(local):
    rnd = random.Random(9)
    words = [w for w in VOCABULARY if len(w) > 5]
    restored = lambda w: local.lexicon.restored(local.editor, w)
    for confusions, least in ((CONFUSED, 0.95), (UNHEARD, 0.9)):
        pairs = [(m, w) for w in words for _ in range(5) if (m := misread(w, rnd, confusions)) and m not in local.lexicon.words]
        assert len(pairs) > 50 and sum(restored(m) == w for m, w in pairs) >= least * len(pairs)
    real = [w for w in VOCABULARY + ["cost", "cast", "h2o", "mp4", "ilobri"]]
    assert sum(restored(w) == w for w in real) >= 0.99 * len(real)


def test_codes_and_names_stay(local):
    for text in ("H2O and mp4 in LT-4125, C4R-UC6 (BS8) 61A 43h v2.1", "Ilobri Kelwex Zanquel Foundry", "f(y) and [unused0]", "the cost of the cast", ""):
        assert local.misread(text) == {}
    assert local.misread("tbe cornpany and pres5ure") == {"tbe": "the", "cornpany": "company", "pres5ure": "pressure"}
    assert local.misread("THE PRE5SURE NEAR") == {"PRE5SURE": "pressure"} or local.misread("THE TEMPERATVRE NEAR") == {"TEMPERATVRE": "temperature"}


@pytest.mark.parametrize(
    "b, operation",
    [
        (Break("tem", "perature"), "join"), (Break("TEM", "PERATURE"), "join"), (Break("xylo", "graphs", soft=True), "join"), (Break("short", "term"), "compound"), (Break("second", "hand"), "compound"),
        (Break("short", "and"), "apart"), (Break("YJ", "H", code=True), "compound"), (Break("ADC", "NUW", code=True), "compound"), (Break("window", "signal"), "compound"), (Break("re", "servoir"), "join"),
    ],
)
def test_line_ends(local, b, operation):
    assert local.editor.at_line_end(b, local.lexicon.words) == operation


PAGE = "The report shows the pressure near the\nwindow during the festival and the\n{furniture}\ncouncil answers the question of the\nengineer in the summer."


@pytest.mark.parametrize("line", ["Page 12", "- 149 -", "— 9 —", "[293]", "p. 112", "8/392", "Page 163 of 385", "049", "52", "xxvii"])
def test_page_numbers(local, line):
    assert "pageno" in local.noise(PAGE.format(furniture=line))


@pytest.mark.parametrize("line", ["table 52", "table | 52", "Figure : 9", "the 52"])
def test_no_page_numbers(local, line):
    assert "pageno" not in local.noise(PAGE.format(furniture=line))


def test_decisions_are_the_weights_own(local):
    """Without weights nothing is found, of any kind."""
    blank = scans.Local(local.lexicon, Editor(local.editor.channel, Perceptron()), pg.Pages(Perceptron(), local.pages.words))
    kinds = [set(), set()]
    for _, _, text, _, _ in corpus(60, 8):
        for i, reader in enumerate((local, blank)):
            kinds[i].update(reader.noise(text))
    assert kinds == [{"glyph", "header", "hyphen", "pageno"}, set()]


def distance(a, b):
    """Edit distance of two texts."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def test_planted_noise_is_found_and_repaired(spark):
    rows = corpus(400, 12)
    df = spark.createDataFrame([(i, b, t, "clash", "clash") for i, b, t, _, _ in rows], "doc_id bigint, bundle_id string, text string, kinds string, heads string")
    model = scans.train(df)
    found = {(r["doc_id"], r["noise"]) for r in scans.find_noise(df, model=model).collect()}
    truth = {(i, k) for i, _, _, _, kinds in rows for k in kinds}
    for kind in ("hyphen", "glyph", "header", "pageno"):
        f, t = {x for x in found if x[1] == kind}, {x for x in truth if x[1] == kind}
        assert len(f & t) >= 0.95 * len(t) and len(f & t) >= 0.95 * len(f), (kind, len(f), len(t), len(f & t))
    done = {r["doc_id"]: r["text"] for r in scans.repair(df, model=model).collect()}
    before = after = size = 0
    for i, _, text, clean, _ in rows[:120]:
        clean = "\n\n".join(clean)
        before, after, size = before + distance(text, clean), after + distance(done[i], clean), size + len(clean)
    assert after <= 0.01 * size and after <= 0.15 * before, (before, after, size)


def test_tables(spark, local):
    model = local.model(spark)
    head, other = "EARLIER FIGURE OF ILOBRI", "Some Title\nThe report shows the pressure.\nThe end."
    paged = "\n".join(PAGE.format(furniture=head) for _ in range(3))
    rows = [(1, "b", paged), (3, "c", other), (4, None, PAGE.format(furniture=f"{head}  17")), (5, "b", None), (6, "b", ""), (7, "b", " \n"), (None, "b", paged), (1, "b", paged)]
    frame = lambda rows: spark.createDataFrame([(i, b, t, "clash") for i, b, t in rows], "doc_id bigint, bundle_id string, text string, row string")
    found = sorted((r["doc_id"], r["noise"]) for r in scans.find_noise(frame(rows), model=model).collect())
    assert found == [(1, "header"), (4, "header"), (4, "pageno")]
    assert scans.find_noise(frame([]), model=model).collect() == [] and scans.repair(frame([]), model=model).collect() == []
    assert scans.find_noise(frame([])).collect() == [] and scans.find_noise(frame([(1, None, "one text alone")])).collect() == []
    text = "The tem-\nperature shows a short-\nEARLIER FIGURE OF ILOBRI\n- 17 -\n\x0c\nterm report. Tbis machine\nanswers.\n\nNext paragraph."
    done = {r["doc_id"]: r["text"] for r in scans.repair(frame([(1, "b", text), (2, "b", None), (3, None, ""), (4, "b", "the river"), (None, "b", "the river")]), model=model).collect()}
    assert done == {1: "The temperature shows a short-term report. This machine answers.\n\nNext paragraph.", 2: None, 3: "", 4: "the river", None: "the river"}


def test_very_long_text(local):
    rnd = random.Random(2)
    text = "\n".join(sentence(rnd) for _ in range(20_000))
    assert local.noise(text) == []
    long = "x" * 5_000
    assert local.misread(f"the {long} report") == {}
