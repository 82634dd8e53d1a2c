"""Encoding against the library, round trips, token counts, mixing."""

import os
import random

import pytest
from pyspark.sql import functions as F

from foliospark.llm import mixture, tokens

PATH = f"{tokens.TOKENIZERS}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")

TEXTS = [
    "", None, " ", "\n\n  \t", "Hello world", "  lead and trail  ", "don't WON'T it's we'll I'VE", "The Ilobri gauge no. 126–141!", "Straße übersteigt größere Zuständigkeit", "Полный район после станции", "设域电录平域表报位277；号报表",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ababababababab", "👩‍🔬 🙂🚀 ✔️", "<|endoftext|> [unused0]", "x" * 3000, "\u0085  　 mixed spaces", "a\x00b\x1cc", "हिन्दी पृष्ठ", "ÅÄÖ ĳ ½ ™", " the the the", "1234567890 12,345.67",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_ids_equal_the_librarys(spark, library):
    rnd = random.Random(4)
    alphabet = ["a", "e", "th", " ", "ing", "ß", "я", "漢", "7", "\n", "'s", "🙂", "-", "Ġ", "é"]
    texts = TEXTS + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 80))) for _ in range(150)] + [" ".join(f"w{i} Zanquel{i % 7}" for i in range(1500))]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string").repartition(3)
    found = {r["doc_id"]: r["ids"] for r in tokens.encode(df).collect()}
    assert found.keys() == set(range(len(texts)))
    assert [i for i, t in enumerate(texts) if found[i] != library(t)] == []
    counts = {r["doc_id"]: r["tokens"] for r in tokens.count_tokens(df).collect()}
    assert all(counts[i] == len(found[i]) for i in counts)
    back = tokens.decode(tokens.encode(df)).collect()
    assert all(r["text"] == (texts[r["doc_id"]] or "") for r in back)


def test_keys_repeats_and_empty(spark, library):
    df = spark.createDataFrame([(None, "a b"), (1, "zz top"), (1, "zz top")], "doc_id bigint, text string")
    assert sorted((r[0] or 0, r[1]) for r in tokens.encode(df).collect()) == [(0, library("a b")), (1, library("zz top")), (1, library("zz top"))]
    assert tokens.encode(df.where("false")).collect() == []
    nothing = spark.createDataFrame([([99999999, 50000000],), (None,), ([],)], "ids array<int>")
    assert [r["text"] for r in tokens.decode(nothing).collect()] == ["", None, ""]


def test_perfect_table():
    keys = {k * 7919 % 2_500_000_000: k for k in range(5000)}
    table, shifts = tokens.perfect_table(keys, 131_071, 19_997)
    assert all(table[(k % 131_071 + shifts[k % 19_997]) % 131_071] == v for k, v in keys.items())


def corpus(spark, n=1500):
    rnd = random.Random(6)
    rows = [(i, "big" if i % 3 else rnd.choice(["small", "mid", "unweighted", None]), " ".join(["word"] * rnd.randrange(1, 60))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, "mid", None), (n + 1, "small", "")], "doc_id bigint, source string, text string")


def test_mixture(spark):
    weights = [mixture.Weight("big", 0.5, 1), mixture.Weight("mid", 0.3, 3), mixture.Weight("none", 0.1, 2), mixture.Weight("small", 0.1, 4)]
    df = corpus(spark)
    runs = [mixture.mix(d, weights).collect() for d in (df, df.repartition(7))]
    assert sorted(map(repr, runs[0])) == sorted(map(repr, runs[1]))
    rows = runs[0]
    assert {r["source"] for r in rows} == {"big", "mid", "small"}
    total, uses = sum(r["tokens"] for r in rows), {}
    for r in rows:
        uses.setdefault((r["source"], r["doc_id"]), []).append(r["copy"])
    caps = {w.source: w.cap for w in weights}
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= caps[s] for (s, _), v in uses.items())
    for s, share in (("big", 5 / 9), ("mid", 3 / 9), ("small", 1 / 9)):
        assert sum(r["tokens"] for r in rows if r["source"] == s) / total == pytest.approx(share, abs=0.01)
    report = {r["source"]: r for r in mixture.shares(mixture.mix(df, weights), weights).collect()}
    assert report["none"]["tokens"] == 0 and sum(r["share"] for r in report.values()) == pytest.approx(1)


def test_mixture_of_nothing(spark):
    df = corpus(spark, 10)
    assert mixture.mix(df, []).collect() == [] and mixture.mix(df.where("false"), [mixture.Weight("big", 1.0, 1)]).collect() == []
    table = spark.createDataFrame([("a", 0.5, 2), (None, 0.5, 1), ("b", None, 1), ("c", 0.1, 0)], "source string, target_share double, max_repeats int")
    assert mixture.weights_of(table) == [mixture.Weight("a", 0.5, 2)]


def test_cut_points_are_poisson():
    cuts = mixture.cut_points(1.5, 4)
    assert cuts[0] == pytest.approx(0.22313) and cuts[1] == pytest.approx(0.557825) and sorted(cuts) == cuts
