"""Look-alike normalization."""

import random
import unicodedata

import pytest

from foliospark.llm import lookalikes
from foliospark.llm.lookalikes import Model, Normalizer, fold

WORDS = "the report shows a proposed pressure near Copenhagen and Café".split()
RUSSIAN = "каждый отчёт показывает новый район после проверки сор".split()


@pytest.fixture(scope="module")
def form(spark):
    df = spark.createDataFrame([(i, " ".join(WORDS + RUSSIAN if i % 2 else WORDS)) for i in range(20)], "doc_id bigint, text string")
    return Normalizer(lookalikes.train(df))


def disguise(text, rnd):
    out = []
    for c in text:
        options = [x for x, _ in lookalikes.LATTICE.get(c, [])] + [c]
        c = rnd.choice(options)
        if rnd.random() < 0.1 and "!" < c <= "~":
            c = chr(ord(c) + 0xFEE0)
        if c == " ":
            c = rnd.choice(" \xa0  ")
        out.append(c + rnd.choice(["", "", "", "​", "⁠", "﻿"]))
    text = "".join(out).replace("fi", rnd.choice(["fi", "ﬁ"])).replace("-", rnd.choice("-‐‑"))
    return unicodedata.normalize(rnd.choice(["NFC", "NFD"]), text)


@pytest.mark.parametrize("seed", range(30))
def test_disguises_come_out_alike(form, seed):
    rnd = random.Random(seed)
    text = rnd.choice(["A well-known Café profits from the official report.", "Every PROPOSED price, 12 (a) of Öl", "Copenhagen " * 20])
    assert form(disguise(text, rnd)) == form(text) == unicodedata.normalize("NFC", text)


@pytest.mark.parametrize(
    "a, b",
    [("Report", "report"), ("über", "uber"), ("10²", "102"), ("½", "1/2"), ("a–b", "a-b"), ("l0", "lo"), ("a b", "ab"), ("™", "TM"), ("🙂", "🚀"), ("👩‍🔬", "👩🔬"), ("हिन्‌दी", "हिन्दी"), ("д", "d"), ("a\nb", "a b")],
)
def test_visible_differences_stay(form, a, b):
    assert form(a) != form(b)


@pytest.mark.parametrize(
    "a, b", [("a\u202eb\u202c", "ab"), ("a\u2066b\u2069", "ab"), ("a\ufe01b", "ab"), ("ab\u3164", "ab"), ("\u2f00\u2f63", "一生"), ("h\u0251t", "hat"), ("a\U000e0101", "a"), ("\u180bx", "x")]
)
def test_invisible_characters_and_other_look_alikes(form, a, b):
    assert form(a) == form(b)


def test_other_scripts_keep_their_letters(form):
    for text in ("каждый отчёт", "новый район после проверки", "Ετήσια σύμβαση", "设域电录", "المجموع 12", "हिन्दी"):
        assert form(text) == unicodedata.normalize("NFC", text)
    # A word of look-alikes alone follows the script of its text, whichever letters it was written in.
    assert form("каждый сор") == form("каждый cop") == "каждый сор"
    assert form("the cop") == form("the сор") == "the cop"


def test_soft_hyphens_show_at_line_ends_only(form):
    assert form("tech\xadnical") == "technical" and form("tech\xad\nnical") == "tech-\nnical"


def test_pairs(spark):
    texts = [(1, "profit now"), (2, "proﬁt\xa0now"), (3, "profit now"), (4, "Profit now"), (5, None), (6, ""), (7, " "), (8, "​"), (9, "рrofit now"), (9, "рrofit now"), (None, "profit  now")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id bigint, text string, look string, characters string")
    found = {tuple(r) for r in lookalikes.lookalike_pairs(df).collect()}
    assert found == {(1, 2), (2, 3), (1, 9), (3, 9), (2, 9)}
    assert lookalikes.lookalike_pairs(df.where("false")).collect() == []
    assert {(r[0], r[1]) for r in lookalikes.normalize(df).where("doc_id in (5, 6)").collect()} == {(5, None), (6, "")}


def test_untrained_and_long():
    form = Normalizer(Model({}))
    assert form("") == "" and form("abc") == "abc"
    assert form("а" * 200_000) == "a" * 200_000
    assert fold("\r\n") == "\n"
