"""Splitting at natural boundaries."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import chunks
from foliospark.llm.chunks import Chunking, split_text

WORD = re.compile("[^" + "".join(re.escape(chr(c)) for c in chunks.SPACES) + "]+")
SETS = [Chunking("a", 12, 3), Chunking("b", 5, 0), Chunking("c", 1, 0), Chunking("d", 7, 6)]


def check(text):
    words = WORD.findall(text)
    for c in SETS:
        pieces = [p for p in split_text(text, [c])]
        assert [p[1] for p in pieces] == list(range(1, len(pieces) + 1))
        assert (len(pieces) > 1) == (len(words) > c.max_words)
        end = 0
        for i, (_, _, first, n, shared, start, stop) in enumerate(pieces):
            assert n <= c.max_words and WORD.findall(text[start:stop]) == words[first : first + n]
            assert shared == (c.overlap_words if i else 0) and first == end - shared and (n > shared or not words)
            end = first + n
        assert end == len(words)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n#-\t\x0c\x1c A!é漢\U0001f600", max_size=400))
def test_any_text(text):
    check(text)


def test_long_texts():
    rnd = random.Random(3)
    check(" ".join(rnd.choice(["word", "end.", "\n\n## Head\n", "- item\n", "CAPS", "x,"]) for _ in range(30_000)))
    check("x" * 100_000)
    check("w " * 50_000)


def test_cuts_where_the_text_breaks():
    text = "# One\n" + "a b c d e f.\n\n" * 2 + "# Two\n" + "g h i j k l.\n\n" * 2
    cut = [text[p[5] : p[6]] for p in split_text(text, [Chunking("s", 16, 0)])]
    assert cut[0].startswith("# One") and cut[1].startswith("# Two") and len(cut) == 2
    sentences = "One two three. Four five six. Seven eight nine ten."
    assert [sentences[p[5] : p[6]] for p in split_text(sentences, [Chunking("s", 6, 0)])] == ["One two three. Four five six.", "Seven eight nine ten."]


def test_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "", "x"), (3, None, "x"), (None, "a", "x"), (4, " \n ", None), (1, "a b c d e f", "x")], "doc_id bigint, text string, piece string")
    table = spark.createDataFrame([("n", 4, 1), ("null", None, 1), (None, 4, 1), ("zero", 0, 0), ("wide", 2, 9)], "chunking_name string, max_words int, overlap_words int")
    sets = chunks.chunkings_of(table)
    assert sets == [Chunking("n", 4, 1), Chunking("wide", 2, 1)]
    rows = chunks.split_oversized(df, sets).where("chunking_name = 'n'").collect()
    assert sorted((r["doc_id"] or 0, r["piece"], r["text"]) for r in rows) == [(0, 1, "a"), (1, 1, "a b c"), (1, 1, "a b c"), (1, 2, "c d e f"), (1, 2, "c d e f"), (2, 1, ""), (4, 1, "")]
    assert chunks.split_oversized(df.where("false"), sets).count() == 0 and chunks.split_oversized(df, []).count() == 0


@pytest.mark.parametrize("words, shared", [(10, 4), (9, 8)])
def test_a_short_first_section_lends_the_overlap(words, shared):
    text = "# A\n" + " ".join(f"w{i}" for i in range(40))
    pieces = list(split_text(text, [Chunking("s", words, shared)]))
    assert all(p[4] == shared for p in pieces[1:]) and all(p[3] <= words for p in pieces)


def cuts(text, words):
    return [text[p[5] : p[6]] for p in split_text(text, [Chunking("s", words, 0)])]


def test_numbers_stay_with_their_items():
    items = [f"{mark} one two three four five" for mark in ("1.", "(2)", "c)", "iv.", "5.1", "12.", "•")]
    for words in (6, 12, 13, 18):
        pieces = cuts("\n".join(items), words)
        assert all(p.splitlines()[0] in items and p.splitlines()[-1] in items for p in pieces) and len(pieces) == -(-7 // (words // 6))
    assert not any(p.split()[-1] in ("1.", "2.", "3.") for p in cuts("\n".join(f"{i}. " + "w " * 9 for i in (1, 2, 3)), 5))
    assert cuts("It fell in part\n3. The rest stayed where it was", 8)[1].startswith("3. The")


def test_nested_items_stay_with_their_parents():
    nested = "- a one two\n  - b one two\n  - c one two\n- d one two\n  - e one two\n  - f one two"
    flat = nested.replace("  -", "-")
    assert cuts(nested, 16)[1].startswith("- d") and cuts(flat, 16)[1].startswith("- e")
    assert [p.split()[1] for p in cuts(nested, 8)] == ["a", "c", "d", "f"] or [p.split()[1] for p in cuts(nested, 8)] == ["a", "c", "e"]
    assert cuts("1. a b\n1.1 c d\n1.2 e f\n2. g h\n2.1 i j\n2.2 k l", 11)[1].startswith("2. g")


def test_rows_of_a_table_and_tags():
    text = "Some words stand here before the table without end\n" + "\n".join(f"row{i}  {i}  {i}" for i in range(6)) + "\nand some words after it stand here too"
    assert [p.split()[0] for p in cuts(text, 18)] == ["Some", "row0", "and"]
    page = "<h1>One</h1> <p>a b c</p> <p>d e f</p> <h1>Two</h1> <ul> <li>g h</li> <li>i j</li> </ul> <p>k l</p>"
    assert cuts(page, 9)[1].startswith("<h1>Two") and [p.split()[0] for p in cuts(page, 4)][:3] == ["<h1>One</h1>", "<p>d", "<h1>Two</h1>"]


def test_what_is_left_of_an_opened_node_joins_its_neighbours():
    text = "a b c d e.\n\n" + "f " * 12 + "g. " + "h " * 12 + "i.\n\n" + "j " * 8 + "k."
    assert [len(p.split()) for p in cuts(text, 20)] == [18, 13, 9] and [len(p.split()) for p in cuts(text, 22)] == [18, 22]
