"""Reports, configuration records, pinned manifests, image subsets, encoders and the benchmark runner."""

import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from foliospark import session
from foliospark.functions.encoders import HashingEncoder
from foliospark.operators import samples
from foliospark.operators.subset import Selection
from foliospark.operators.validate import ContractError
from foliospark.plans import benchmark, reports
from foliospark.plans.evaluation import Bm25Index, DenseIndex
from foliospark.sources import config, datasets, images

DOCS = [("d1", "apples and pears"), ("d2", "ships sail home"), ("d3", "apples sail"), ("d4", "")]
ASKED, JUDGED = [("q1", "apples pears"), ("q2", "ships")], [("q1", "d1"), ("q2", "d2")]


def frames(spark):
    return spark.createDataFrame(DOCS, "document_id string, text string"), spark.createDataFrame(ASKED, "query_id string, text string"), spark.createDataFrame(JUDGED, "query_id string, document_id string")


@pytest.mark.parametrize("kind", ["bm25", "dense"])
def test_evaluation_of_an_index(spark, kind):
    docs, queries, qrels = frames(spark)
    index = Bm25Index(docs, max_words=8, overlap=0) if kind == "bm25" else DenseIndex(docs, HashingEncoder(64), 64, 8, 0)
    found = reports.evaluate_index(kind, index, queries, docs, qrels, k=2, index_bytes=7, warmups=1, calls=2)
    assert found["metrics"]["mrr_at_2"] == 1 and found["top_k"]["q2"][0] == "d2" and len(found["top_k"]["q1"]) == 2
    assert found["latency_ms"]["calls"] == 2 and found["latency_ms"]["p50"] <= found["latency_ms"]["p95"] and found["pairs_per_second"] > 0 and found["index_bytes"] == 7
    again = reports.scorer_result(kind, reports.top_k_padded(index.score(queries), queries, docs, 2), qrels, 2, 7)
    assert again["fingerprint"] == found["fingerprint"] and "latency_ms" not in again


def test_pair_payload_and_roles(spark):
    rows = [("a", 0, True, [1.0, 0.0]), ("a", 1, True, [0.0, 1.0]), ("b", 0, True, [0.0, -1.0]), ("b", 1, False, [0.0, 0.0]), ("b", 1, False, [0.0, 0.0])]
    pages = spark.createDataFrame(rows, "document_id string, pos int, mask boolean, emb array<float>")
    asked = pages.withColumnRenamed("document_id", "query_id")
    qrels = spark.createDataFrame([("a", "a"), ("b", "b")], "query_id string, document_id string")
    found = reports.evaluate_pair(asked, pages, qrels, 2, k=1)
    assert found["late_interaction"]["metrics"]["mrr_at_1"] == found["mean_vectors"]["metrics"]["mrr_at_1"] == 1
    assert found["late_interaction"]["index_bytes"] == 4 * 9 and found["mean_vectors"]["index_bytes"] == 2 * 8
    assert reports.payload(pages.where("false"), 2).first()["ratio"] is None
    scores = reports.late_interaction(reports.Encoded(asked, "query"), reports.Encoded(pages, "document"), 2, k=1)
    assert {(r[0], r[1]) for r in scores.collect()} == {("a", "a"), ("b", "b")}
    for bad in (lambda: reports.Encoded(pages, "query"), lambda: reports.Encoded(pages, "page"), lambda: reports.late_interaction(reports.Encoded(pages, "document"), reports.Encoded(pages, "document"), 2)):
        with pytest.raises(ContractError):
            bad()


def test_rankings_and_judgements_must_name_the_same_queries(spark):
    docs, _, qrels = frames(spark)
    ranked = spark.createDataFrame([("q1", "d1", 1), ("q2", "d3", 1)], "query_id string, document_id string, rank int")
    assert reports.strict_metrics(ranked, qrels, 1, docs).first()["mrr_at_1"] == 0.5
    more = qrels.union(spark.createDataFrame([("q3", "d9")], qrels.schema))
    assert {tuple(r) for r in reports.coverage_violations(ranked, more, docs).collect()} == {("q3", "unranked"), ("d9", "unknown")}
    assert [tuple(r) for r in reports.coverage_violations(ranked, qrels.where("query_id = 'q1'")).collect()] == [("q2", "unjudged")]
    with pytest.raises(ContractError):
        reports.strict_metrics(ranked, more, 1)


def test_timings_are_recomputed(spark):
    raw = spark.createDataFrame([("w", c, float(x)) for c in "ab" for x in (1, 2, 4)], "workload string, candidate string, latency_ms double")
    good = samples.workload_p50(raw)
    assert reports.recomputed_timings(raw, good).count() == 0
    assert reports.recomputed_timings(raw, good.withColumn("p50", F.col("p50") * (1 + 1e-9))).count() == 2
    assert reports.recomputed_timings(raw.where("candidate = 'a'"), good).count() == 1
    gate = reports.accepted(good, {"fast": F.col("p50") < 3, "null": F.lit(None).cast("boolean")}).first()
    assert gate["fast"] and not gate["null"] and not gate["accepted"]
    pairs = lambda x: spark.createDataFrame([("k", x)], "k string, score double")
    assert samples.agreement_or_null(pairs(float("inf")), pairs(1.0), ["k"], 0, 0).first()["max_absolute_error"] is None


CASE = {"name": "c", "queries": 2, "query_tokens": 3, "active_query_tokens": 2, "documents": 3, "document_tokens": 4, "active_document_tokens": 4, "width": 4}
BENCH = {"seed": 1, "warmups": 0, "trials": 2, "absolute_tolerance": 1e-6, "relative_tolerance": 0, "cases": [CASE]}


def test_benchmark_compares_before_it_times(spark, tmp_path):
    path = tmp_path / "bench.json"
    path.write_text(json.dumps(BENCH))
    read = config.load(config.BenchmarkConfig, str(path))
    block = lambda q, d, w: reports.maxsim.maxsim(q, d, w)
    small = lambda q, d, w: reports.maxsim.maxsim(q, d, w, block_tokens=2)
    measured = benchmark.measure(spark, read, {"block": block, "small": small}, "block")
    assert measured.where("call = 'trial'").count() == 4 and measured.where("call = 'cold'").count() == 2
    assert {r["candidate"] for r in benchmark.summary(measured).collect()} == {"block", "small"}
    with pytest.raises(ContractError):
        benchmark.measure(spark, read, {"block": block, "wrong": lambda q, d, w: block(q, d, w).withColumn("score", F.col("score") + 1)}, "block")


@pytest.mark.parametrize(
    "change",
    [{"trials": 0}, {"trials": True}, {"trials": "2"}, {"cases": []}, {"cases": [CASE, CASE]}, {"extra": 1}, {"cases": [{**CASE, "active_query_tokens": 9}]}, {"cases": [{**CASE, "width": 0}]}, {"warmups": -1}],
)
def test_broken_configurations_are_refused(change):
    assert config.record(config.BenchmarkConfig, BENCH).cases[0].width == 4
    with pytest.raises(ContractError):
        config.record(config.BenchmarkConfig, BENCH | change)


def test_other_configurations():
    text = {"max_words": 192, "overlap_words": 32, "k": 5, "bm25": {"k1": 1.5, "b": 0.75, "epsilon": 0.25}}
    assert config.record(config.TextConfig, text).bm25.k1 == 1.5
    subset = {"k": 5, "warmups": 1, "selections": [{"task": "a", "salt": "s", "queries": 1, "documents": 2}]}
    assert config.record(config.SubsetConfig, subset).selections == (Selection("a", "s", 1, 2),)
    for kind, value in ((config.TextConfig, text | {"overlap_words": 192}), (config.TextConfig, text | {"bm25": {"k1": 0, "b": 0.75, "epsilon": 0}}), (config.SubsetConfig, subset | {"selections": subset["selections"] * 2}), (config.SubsetConfig, [])):
        with pytest.raises(ContractError):
            config.record(kind, value)


def pinned(**change):
    files = {p: {"path": f"data/{p}.parquet", "size": 3, "sha256": "a" * 64} for p in ("corpus", "queries", "qrels", "texts")}
    return {"name": "set-1", "repository": "owner/pages", "revision": "0" * 40, "documents": 4, "query_count": 3} | files | change


def test_pinned_manifests(spark, tmp_path):
    read = datasets.PinnedManifest.parse(json.dumps(pinned()))
    assert read.urls("https://host")["qrels"] == f"https://host/owner/pages/resolve/{'0' * 40}/data/qrels.parquet" and read.manifest().queries == "data/queries.parquet"
    file = lambda **x: {"path": "p", "size": 1, "sha256": "b" * 64} | x
    for change in ({"revision": "main"}, {"repository": "pages"}, {"name": "Set"}, {"documents": 0}, {"more": 1}, *({"corpus": file(**x)} for x in ({"path": "/etc/x"}, {"path": "a/../b"}, {"path": ""}, {"sha256": "B" * 64}, {"size": -1}, {"size": True}, {"path": "data/texts.parquet"}))):
        with pytest.raises(ContractError):
            datasets.PinnedManifest.parse(json.dumps(pinned(**change)))
    target = tmp_path / "data"
    target.mkdir()
    (target / "corpus.parquet").write_bytes(b"abc")
    with pytest.raises(ContractError):  # another digest than the manifest's
        datasets.load_pinned(spark, read, lambda p: f"{tmp_path}/{p}")


def png(width, height):
    return bytes.fromhex(images.PNG_HEAD) + struct.pack(">II", width, height) + b"rest"


def test_image_subsets(spark):
    rows = [("t", str(i), png(i + 1, 2)) for i in range(6)] + [("other", "9", None)]
    corpus = spark.createDataFrame(rows, "task string, document_id string, bytes binary")
    asked = spark.createDataFrame([("t", "q")], "task string, query_id string")
    qrels = spark.createDataFrame([("q", "3")], "query_id string, document_id string")
    take = lambda c, n=3: images.load_subset(c, asked, qrels, [Selection("t", "s", 1, n)])
    one, two = take(corpus), take(corpus.repartition(5))
    found = {r["document_id"]: r for r in one.pages.collect()}
    assert len(found) == 3 and found["3"]["positive"] and found["3"]["width"] == 4 and found["3"]["sha256"] == hashlib.sha256(png(4, 2)).hexdigest()
    assert (one.selection_fingerprint, one.content_fingerprint) == (two.selection_fingerprint, two.content_fingerprint)
    changed = take(corpus.withColumn("bytes", F.when(F.col("document_id") == "3", F.lit(png(7, 7))).otherwise(F.col("bytes"))))
    assert changed.selection_fingerprint == one.selection_fingerprint and changed.content_fingerprint != one.content_fingerprint
    for bad in (corpus.union(corpus.limit(1)), corpus.withColumn("bytes", F.lit(b"no image"))):
        with pytest.raises(ContractError):
            take(bad)


def test_hashing_encoder(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "ONE two"), (3, ""), (4, None), (5, "three")], "id int, text string").withColumn("emb", F.lit("clash"))
    found = {r["id"]: r["emb"] for r in HashingEncoder(32, 1).encode(df.repartition(3)).collect()}
    assert found[1] == found[2] != found[5] and found[3] == [0.0] * 32 and found[4] is None and sum(x * x for x in found[5]) == pytest.approx(1)
    assert found[5] != {r["id"]: r["emb"] for r in HashingEncoder(32, 2).encode(df).collect()}[5]


def test_intermediate_tables_can_be_deleted(spark):
    import os

    with session.scratch(spark):
        path = session.written_at(spark.range(3).toDF("id"))
        assert os.path.isdir(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:"))
