"""Tokenizing, windows, prompts and BM25 against a plain loop."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.operators import bm25, ranking
from foliospark.plans.evaluation import Bm25Index, evaluate, top_k_padded


def test_tokens(spark):
    df = spark.createDataFrame([(" ＦＯＯ Café—Straße_42 中文! ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.tokenize("t")).collect()] == [["foo", "café", "strasse", "42", "中文"], [], None]
    assert spark.createDataFrame([("Straße ΟΔΟΣ a_b",)], "t string").select(text.tokenize_plain(F.col("t"))).first()[0] == ["strasse", "οδοσ", "a", "b"]


def test_windows(spark):
    df = spark.createDataFrame([(1, " a\n b  c\td e "), (2, " \n"), (3, None), (4, "")], "id int, t string")
    rows = sorted((r["id"], r["chunk"], " ".join(r["words"])) for r in text.chunk_windows(df, "t", 3, 1).collect())
    assert rows == [(1, 0, "a b c"), (1, 1, "c d e"), (2, 0, ""), (4, 0, "")]
    for bad in ((3, 3), (3, -1), (0, 0)):
        with pytest.raises(ValueError):
            text.check_windows(*bad)
    with pytest.raises(TypeError):
        text.check_windows(True, 0)


def test_blank_and_prompt(spark):
    df = spark.createDataFrame([("q?",), ("   ",), ("a<unused0>",), (None,)], "t string")
    assert [r[0] for r in df.select(text.is_blank(F.col("t"))).collect()] == [False, True, False, None] or [r[0] for r in df.select(text.is_blank(F.col("t"))).collect()] == [False, True, False, False]
    assert [r[0] for r in df.select(text.prompt(F.col("t"))).collect()] == ["Question: q?" + "<unused0>" * 5, None, None, None]


def loop(pages, query, size, overlap, k1, b, epsilon):
    """The textbook computation, one chunk after the other."""
    chunks, owner = [], []
    for name, value in pages.items():
        words = value.split()
        starts = range(0, max(1, len(words) - overlap), size - overlap)
        for s in starts:
            chunks.append(text.tokens_of(" ".join(words[s : s + size])))
            owner.append(name)
    n, average = len(chunks), sum(map(len, chunks)) / len(chunks)
    df = Counter(t for c in chunks for t in set(c))
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = epsilon * sum(idf.values()) / len(idf) if idf else 0
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    out = {}
    for name, c in zip(owner, chunks):
        tf = Counter(c)
        s = sum(idf.get(t, 0) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(c) / average)) for t in text.tokens_of(query) if tf[t])
        out[name] = max(out.get(name, -math.inf), s)
    return out


@pytest.mark.parametrize("plain", [False, True])
def test_bm25_equals_the_loop(spark, plain):
    pages = {"blank": " \n", "short": "common rare", "medium": "common common word other", "long": "common " * 7 + "needle word", "rare": "common unique"}
    docs = spark.createDataFrame([*pages.items(), ("null", None)], "document_id string, text string")
    queries = {"a": "common needle needle", "b": "unique absent", "c": "", "d": "word"}
    index = bm25.build(docs, 3, 1, bm25.Parameters(1.2, 0.6, 0.4), plain)
    found = {(r[0], r[1]): r[2] for r in bm25.scores(index, spark.createDataFrame([*queries.items(), ("e", None)], "query_id string, text string")).collect()}
    for q, t in queries.items():
        for page, s in loop(pages, t, 3, 1, 1.2, 0.6, 0.4).items():
            assert found.get((q, page), 0.0) == pytest.approx(s, rel=1e-12), (q, page)
    postings = index.postings.count()
    terms = [r["term"] for r in index.terms.collect()]
    assert index.bytes().first()[0] == sum(len(t.encode()) + 8 for t in terms) + 16 * postings + 16 * index.chunks.count()


def test_parameters():
    for bad in ({"k1": 0}, {"b": 1.1}, {"epsilon": -1}):
        with pytest.raises(ValueError):
            bm25.Parameters(**bad)
    for bad in ({"k1": True}, {"b": float("nan")}):
        with pytest.raises(TypeError):
            bm25.Parameters(**bad)


def test_padded_ranking_and_evaluation(spark):
    docs = spark.createDataFrame([("d0", "apple apple"), ("d1", "banana"), ("d2", "banana"), ("d3", "")], "document_id string, text string")
    queries = spark.createDataFrame([("q", "apple"), ("none", "zzz")], "query_id string, text string")
    index = Bm25Index(docs, max_words=4, overlap=0)
    ranked = top_k_padded(index.score(queries), queries, docs, 3)
    assert [r[1] for r in sorted((r["rank"], r["document_id"]) for r in ranked.where("query_id = 'q'").collect())] == ["d0", "d3", "d2"]
    assert [r[1] for r in sorted((r["rank"], r["document_id"]) for r in ranked.where("query_id = 'none'").collect())] == ["d3", "d2", "d1"]
    found = evaluate(index, queries, docs, spark.createDataFrame([("q", "d0")], "query_id string, document_id string"), 3)
    assert found["mrr_at_3"] == 1 and found["queries"] == 1


def test_top_k_of_blocks_is_that_of_the_postings(spark):
    import random

    rnd = random.Random(3)
    texts = [" ".join(rnd.choices("ab cd ef gh ij kl mn op".split(), k=rnd.randrange(0, 30))) for _ in range(60)] + ["", "zz " * 9]
    docs = spark.createDataFrame([(f"d{i:02}", t) for i, t in enumerate(texts)] + [("null", None), (None, "ab")], "document_id string, text string").repartition(3)
    queries = spark.createDataFrame([("q1", "ab cd ab"), ("q2", "zz"), ("q3", "unknown"), ("q4", ""), ("q5", None), (None, "ab"), ("q6", "kl mn op gh")], "query_id string, text string")
    index = bm25.build(docs.where("document_id is not null"), 8, 2, plain=True)
    known = queries.where("query_id is not null and text is not null")
    best = lambda df: {(r["query_id"], r["document_id"], r["score"], r["rank"]) for r in df.collect()}
    expected = best(top_k_padded(bm25.scores(index, known).withColumn("score", F.round("score", 6)), known, docs.where("text is not null and document_id is not null"), 4))
    for terms in (1, 5, 2048):
        assert best(ranking.rank_scores(bm25.top_k(index, queries, 4, digits=6, block_terms=terms), k=4)) == expected
    assert len(expected) == 20 and bm25.top_k(index, queries.where("false"), 4).collect() == []


def shuffled(spark):
    """Rows that all stages of the session have shuffled so far."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_bm25_scores_are_not_shuffled(spark):
    pages = {f"p{i:03}": f"common shared word{i % 7} " * 3 + "filler " * (i % 9) for i in range(300)}
    docs = spark.createDataFrame([*pages.items()], "document_id string, text string").repartition(3)
    queries = spark.createDataFrame([(f"q{i:02}", f"common shared word{i % 9}") for i in range(80)], "query_id string, text string")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = shuffled(spark)
    found = bm25.scores(bm25.build(docs, 8, 2, plain=True), queries).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    # Each page holds a word of each query: what is shuffled grows with pages and with queries, not with their pairs.
    assert found == 300 * 80 and shuffled(spark) - before < found / 4


@pytest.mark.parametrize("epsilon", [0.0, 0.25])
def test_bm25_scores_of_blocks_of_queries(spark, monkeypatch, epsilon):
    import random

    rnd = random.Random(5)
    # "x" stands in nearly all windows; some pages have many windows and some windows lack every term of a query.
    pages = {f"p{i:02}": " ".join(rnd.choices(["x x", "ab", "cd", "ef", "gh", "zz zz zz zz zz zz zz zz"], [9, 1, 1, 1, 1, 1], k=rnd.randrange(0, 40))) for i in range(40)} | {"blank": "  "}
    docs = spark.createDataFrame([*pages.items(), ("null", None)], "document_id string, text string").repartition(3)
    queries = {"q1": "x", "q2": "x ab ab", "q3": "gh cd", "q4": "unknown", "q5": "", "q6": "zz ef unknown"}
    asked = spark.createDataFrame([*queries.items(), ("q7", None), (None, "x")], "query_id string, text string")
    index = bm25.build(docs, 6, 2, bm25.Parameters(epsilon=epsilon), plain=True)
    known = {r["term"] for r in index.terms.collect()}
    expected = {(q, page): s for q, t in queries.items() for page, s in loop(pages, t, 6, 2, 1.5, 0.75, epsilon).items() if {*t.split()} & {*pages[page].split()} & known}
    assert len(expected) > 120 and (epsilon or any(s == 0 for s in expected.values()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # pages that go on in the next batch
    try:
        for pairs, cells in ((bm25.BLOCK_PAIRS, bm25.CELLS), (1, bm25.CELLS), (4, 8)):
            monkeypatch.setattr(bm25, "CELLS", cells)
            rows = bm25.scores(index, asked, block_pairs=pairs).collect()
            assert len(rows) == len(expected) and {(r[0], r[1]): r[2] for r in rows} == pytest.approx(expected, rel=1e-12, abs=1e-12)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert bm25.scores(index, asked.where("false")).collect() == []
    assert {r[2] for r in bm25.scores(index, asked, digits=2).collect()} == {round(r[2], 2) for r in rows}


def test_padding_before_matches_below_zero(spark):
    docs = spark.createDataFrame([(f"d{i}",) for i in range(9)] + [(None,), ("d8",)], "document_id string")
    queries = spark.createDataFrame([("q",), ("none",), ("p",), (None,)], "query_id string")
    scores = spark.createDataFrame([*[("q", f"d{i}", -1.0) for i in (5, 6, 7, 8)], ("p", "d1", 2.0), ("p", "d8", -3.0), ("p", "d7", 0.0)], "query_id string, document_id string, score double")
    found = {}
    for r in sorted(top_k_padded(scores, queries, docs, 2).collect(), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["document_id"], r["score"]))
    assert found == {"q": [("d4", 0.0), ("d3", 0.0)], "none": [("d8", 0.0), ("d7", 0.0)], "p": [("d1", 2.0), ("d7", 0.0)]}
    assert {r["query_id"] for r in top_k_padded(scores.where("score > 0"), queries, docs, 2).collect()} == {"q", "none", "p"}
