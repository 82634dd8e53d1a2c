"""The subsets of all tasks, as large as their specifications ask for."""

import hashlib

import pytest

from foliospark import queries
from foliospark.operators import subset
from foliospark.operators.validate import ContractError


@pytest.fixture()
def folder(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    put("selection_specs", [("memo", "s", 8, 12), ("form", "t", 9, 6)], "task string, salt string, queries_per_task int, documents_per_task int")
    put("corpus", [(i, "memo" if i < 20 else "form") for i in range(30)], "`corpus-id` bigint, task string")
    put("queries", [(i, f"q{i}", "memo" if i < 12 else "form") for i in range(18)], "`query-id` bigint, query string, task string")
    put("qrels", [(i, i, 1) for i in range(12)] + [(i, 20 + i % 5, 1) for i in range(12, 18)], "`query-id` bigint, `corpus-id` bigint, score bigint")
    return str(tmp_path)


def test_each_task_gives_the_queries_it_is_asked_for(spark, folder):
    def first(salt, ids, n):
        return set(sorted(map(str, ids), key=lambda i: hashlib.sha256(f"{salt}\0query\0{i}".encode()).hexdigest())[:n])

    found = queries.subset_queries(spark, folder).collect()
    memo, form = first("s", range(12), 8), first("t", range(12, 18), 9)  # forms have six only
    assert {r["query_id"] for r in found if r["task"] == "memo"} == memo and {r["query_id"] for r in found if r["task"] == "form"} == form
    pages = queries.subset_documents(spark, folder).collect()
    assert {r["document_id"] for r in pages if r["task"] == "memo" and r["positive"]} == memo
    assert {r["document_id"] for r in pages if r["task"] == "form" and r["positive"]} == {str(20 + int(i) % 5) for i in form}
    assert sorted((t, sum(r["task"] == t for r in pages)) for t in ("memo", "form")) == [("form", 6), ("memo", 12)]


def test_strict_subsets_of_several_tasks(spark):
    pages = spark.createDataFrame([("a", str(i)) for i in range(6)] + [("b", str(i)) for i in range(6, 9)], "task string, document_id string")
    asked = spark.createDataFrame([("a", "q1"), ("a", "q2"), ("b", "q3"), ("b", "q1")], "task string, query_id string")
    qrels = spark.createDataFrame([("q1", "1"), ("q2", "2"), ("q3", "7")], "query_id string, document_id string")
    take = lambda *s, strict=True: subset.select_subsets(pages, asked, qrels, [subset.Selection(*x) for x in s], strict)
    chosen, found = take(("a", "s", 2, 4))
    assert {r["query_id"] for r in chosen.collect()} == {"q1", "q2"} and {r["document_id"] for r in found.where("positive").collect()} == {"1", "2"} and found.count() == 4
    for bad in (("a", "s", 3, 4), ("a", "s", 2, 1), ("a", "s", 2, 7), ("b", "s", 2, 3)):
        with pytest.raises(ContractError):
            take(bad)
    chosen, found = take(("a", "s", 9, 90), ("b", "t", 2, 2), ("c", "u", 1, 1), strict=False)
    assert {(r["task"], r["query_id"]) for r in chosen.collect()} == {("a", "q1"), ("a", "q2"), ("b", "q3")}
    assert {(r["task"], r["document_id"]) for r in found.where("positive").collect()} == {("a", "1"), ("a", "2"), ("b", "7")} and found.count() == 8
    for bad in (("", "s", 1, 1), ("a", "s", 0, 1), ("a", "s", 1, True)):
        with pytest.raises(ContractError):
            subset.Selection(*bad)
    table = spark.createDataFrame([("a", "s", 1, 1), ("a", "t", 1, 1)], "task string, salt string, queries_per_task int, documents_per_task int")
    with pytest.raises(ContractError):
        subset.selections_of(table)
