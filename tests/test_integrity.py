"""Validators, subsets, fingerprints, sources and sinks, streaming."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from foliospark.operators import bm25, fingerprints, subset, validate
from foliospark.sources import datasets, files
from foliospark.streaming import ingest

PAGES, QUERIES = [(4,), (5,), (7,), (9,)], [(31, "how much rain fell in May?"), (32, "who signed the lease?"), (35, "what does the chart count?")]
JUDGED = [(32, 4, 1), (31, 5, 1), (31, 7, 1), (35, 9, 1)]
TEXTS = [("who signed the lease?", "lease, signed by both owners"), ("how much rain fell in May?", "weather table, spring"), ("how much rain fell in May?", ""), ("what does the chart count?", "boats by harbour")]


def dataset(spark, folder, corpus=PAGES, queries=QUERIES, qrels=JUDGED, texts=TEXTS, score="bigint", parts=1):
    tables = {"corpus": (corpus, "`corpus-id` bigint"), "queries": (queries, "`query-id` bigint, query string"), "qrels": (qrels, f"`query-id` bigint, `corpus-id` bigint, score {score}"), "texts": (texts, "query string, text_description string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(parts).write.parquet(f"{folder}/{name}")
    return datasets.Manifest("t", *(f"{folder}/{n}" for n in ("corpus", "queries", "qrels", "texts")), 4, 3)


@pytest.mark.parametrize("parts", [1, 3])
def test_load(spark, tmp_path, parts):
    found = datasets.load(spark, dataset(spark, tmp_path, parts=parts))
    assert {(r[0], r[1]) for r in found.documents.collect()} == {("4", "lease, signed by both owners"), ("5", "weather table, spring"), ("7", ""), ("9", "boats by harbour")}
    assert {r[1] for r in found.qrels.where("query_id = '31'").collect()} == {"5", "7"}
    assert datasets.task_counts(found).first().asDict() == {"documents": 4, "empty_documents": 1, "judgements": 4}


@pytest.mark.parametrize(
    "change",
    [
        {"queries": [*QUERIES, (40, "a question without a page")]},
        {"qrels": [*JUDGED[:3], (35, 9, 2)]},
        {"qrels": [(32, 4, None), *JUDGED[1:]]},
        {"qrels": [*JUDGED[:3], (35, 8, 1)]},
        {"qrels": [*JUDGED[:3], (36, 9, 1)]},
        {"qrels": [JUDGED[0], JUDGED[2], JUDGED[1], JUDGED[3]]},
        {"texts": [TEXTS[0], ("how much rain fell in June?", TEXTS[1][1]), *TEXTS[2:]]},
        {"texts": [*TEXTS[:3], (TEXTS[3][0], None)]},
        {"corpus": [(4,), (5,), (7,), (7,)]},
        {"queries": [*QUERIES[:2], (35, None)]},
    ],
)
def test_broken_datasets_are_refused(spark, tmp_path, change):
    with pytest.raises(validate.ContractError):
        datasets.load(spark, dataset(spark, tmp_path, **change))


def test_row_index_runs_over_all_files(spark, tmp_path):
    spark.range(0, 10, 1, 3).selectExpr("id", "'clash' as file_").write.parquet(f"{tmp_path}/t")
    found = validate.with_row_index(spark.read.parquet(f"{tmp_path}/t").drop("file_")).collect()
    assert sorted((r["id"], r["row_index"]) for r in found) == [(i, i) for i in range(10)]


def test_a_null_judgement_is_not_relevant(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 2), (None, None, 1)], "q int, c int, score bigint")
    assert sorted(r["c"] or 0 for r in validate.relevant(rows).collect()) == [0, 2]
    assert validate.relevant(rows.withColumn("score", F.lit("1"))).count() == 0


@pytest.mark.parametrize("score", [True, "1", float("nan"), float("inf")])
def test_relevance_is_exactly_one(spark, score):
    kind = {bool: "boolean", str: "string", float: "double"}[type(score)]
    assert validate.not_relevant(spark.createDataFrame([(1, 1, score)], f"q int, c int, score {kind}")).count() == 1


def test_ids_are_integers_or_strings(spark):
    for kind in ("boolean", "double"):
        with pytest.raises(validate.ContractError):
            validate.as_id(spark.createDataFrame([], f"id {kind}"), "id")


def test_scan_reads_only_its_columns(spark, tmp_path):
    spark.createDataFrame([(1, "x", b"y")], "id int, t string, image binary").write.parquet(f"{tmp_path}/t")
    plan = files.scan(spark, f"{tmp_path}/t", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:int>" in plan
    with pytest.raises(validate.ContractError):
        files.scan(spark, f"{tmp_path}/t", ["missing"])


def test_tokens_contract(spark):
    rows = [("a", 0, True, [1.0]), ("b", 0, False, [0.0]), ("c", 0, None, [float("nan")]), ("d", 0, True, [1.0]), ("d", 1, False, [2.0]), ("e", 0, False, [0.0]), ("e", 1, True, [1.0])]
    df = spark.createDataFrame(rows, "id string, pos int, mask boolean, emb array<float>")
    assert {r[0] for r in validate.token_violations(df, "id").collect()} == {"b", "c", "d"}
    assert {r[0] for r in validate.not_right_padded(df, "id").collect()} == {"e"}


def test_subset_against_a_loop(spark):
    rank = lambda kind, i: (hashlib.sha256(f"stable\0{kind}\0{i}".encode()).hexdigest(), i)
    corpus, judged = [str(i) for i in range(30)], {f"q{i}": {str(i), str(i + 1)} for i in range(8)}
    asked = sorted(judged, key=lambda i: rank("query", i))[:3]
    need = set().union(*(judged[q] for q in asked))
    docs = need | set(sorted(set(corpus) - need, key=lambda i: rank("document", i))[: 10 - len(need)])
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    c, q = frame([(x,) for x in corpus], "document_id string"), frame([(x,) for x in judged], "query_id string")
    r = frame([(a, d) for a, ds in judged.items() for d in ds] * 2, "query_id string, document_id string")
    chosen, documents = subset.select_subset(c, q, r, "stable", 3, 10)
    assert {x[0] for x in chosen.collect()} == set(asked) and {x["document_id"] for x in documents.collect()} == docs
    for args in ((3, 2), (9, 30), (3, 31)):
        with pytest.raises(validate.ContractError):
            subset.select_subset(c, q, r, "stable", *args)


def test_dataset_digest_is_that_of_the_canonical_form(spark):
    docs, queries, qrels = [("2", "zwei ü"), ("1", 'a"b')], [("q2", "x"), ("q1", "y")], [("q1", "2"), ("q1", "1"), ("q2", "1")]
    expected = fingerprints.canonical_digest({
        "format": "tag",
        "documents": [{"document_id": i, "text": t} for i, t in sorted(docs)],
        "queries": [{"query_id": q, "text": t, "relevant_document_ids": sorted(d for x, d in qrels if x == q)} for q, t in sorted(queries)],
    })
    frames = lambda n: (spark.createDataFrame(docs, "document_id string, text string").repartition(n), spark.createDataFrame(queries, "query_id string, text string"), spark.createDataFrame(qrels, "query_id string, document_id string").repartition(n))
    assert fingerprints.dataset_digest(*frames(1), "tag") == fingerprints.dataset_digest(*frames(3), "tag") == expected
    with pytest.raises(ValueError):
        fingerprints.canonical_json({"x": float("nan")})
    a = fingerprints.score_matrix_digest(["q"], ["d"], [[1.0]], "tag")
    assert a != fingerprints.score_matrix_digest(["q"], ["d"], [[2.0]], "tag")


def test_seed(spark):
    expected = int.from_bytes(hashlib.sha256(b"17\0case").digest()[:8], "big") % (2**63 - 1)
    assert spark.range(1).select(subset.stable_seed(F.lit("17\0case"))).first()[0] == expected


def test_artifacts(spark, tmp_path):
    path = tmp_path / "a.bin"
    path.write_bytes(b"content")
    good = files.Artifact(str(path), 7, hashlib.sha256(b"content").hexdigest())
    assert files.verify(spark, [good]).count() == 1 and files.file_digest(str(path)) == good.sha256
    for bad in (files.Artifact(good.path, 8, good.sha256), files.Artifact(good.path, 7, "0" * 64)):
        with pytest.raises(validate.ContractError):
            files.verify(spark, [bad])


def test_strict_json_and_reports(tmp_path):
    assert files.strict_json('{"a": 1}', {"a"}) == {"a": 1}
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}', "[]", '{"b": 1}'):
        with pytest.raises(validate.ContractError):
            files.strict_json(bad, {"a"})
    target = str(tmp_path / "r.json")
    files.write_json(target, {"x": "ü"})
    assert json.load(open(target, encoding="utf-8")) == {"x": "ü"}
    with pytest.raises(FileExistsError):
        files.write_json(target, {})
    files.write_json(target, {"y": 1}, overwrite=True)
    with pytest.raises(ValueError):
        files.write_json(target, {"y": float("nan")}, overwrite=True)
    with pytest.raises(IsADirectoryError):
        files.preflight(str(tmp_path), True)
    assert [p.name for p in tmp_path.iterdir()] == ["r.json"]
    assert files.pinned_url("https://h/", "o/n", "abc", "a b/c.parquet") == "https://h/o/n/resolve/abc/a%20b/c.parquet"


def test_manifests_and_registry():
    text = json.dumps({"name": "t", "corpus": "c", "queries": "q", "qrels": "r", "texts": "x", "documents": 3, "query_count": 2})
    manifest = datasets.Manifest.parse(text)
    assert datasets.Registry(manifest)["t"] is manifest
    with pytest.raises(KeyError, match="known: t"):
        datasets.Registry(manifest)["other"]
    with pytest.raises(validate.ContractError):
        datasets.Manifest.parse(text.replace("3", "true"))


def test_ingest_takes_each_file_once(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([("1", "a b a"), ("2", None)], "document_id string, text string").write.parquet(source)
    ingest.ingest(spark, source, target, state).awaitTermination()
    spark.createDataFrame([("3", "b")], "document_id string, text string").write.mode("append").parquet(source)
    ingest.ingest(spark, source, target, state).awaitTermination()
    assert {(r["document_id"], r["term"], r["tf"]) for r in spark.read.parquet(f"{target}/postings").collect()} == {("1", "a", 2), ("1", "b", 1), ("3", "b", 1)}
    asked = spark.createDataFrame([("q", "a b"), ("r", "b")], "query_id string, text string")
    whole = bm25.build(spark.read.parquet(source), plain=True)
    scores = lambda index: {(r[0], r[1], round(r[2], 9)) for r in bm25.scores(index, asked).collect()}
    assert scores(ingest.opened(spark, target)) == scores(whole) and len(scores(whole)) == 4


def test_entry_points_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
