"""Rankings, metrics, samples."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import metrics, ranking, samples

NAN, INF = float("nan"), float("inf")


def scored(spark, rows):
    return spark.createDataFrame(rows, "query_id string, document_id string, score double")


def test_ties_go_to_the_greater_id(spark):
    df = scored(spark, [("q", d, s) for d, s in (("1", 0.0), ("10", -0.0), ("2", 0.0), ("x", NAN), ("y", INF), ("z", None))])
    assert [r["document_id"] for r in ranking.rank_scores(df).orderBy("rank").collect()] == ["2", "10", "1"]
    assert ranking.top_lists(ranking.rank_scores(df), 2).first()["documents"] == ["2", "10"]


def test_k_must_be_a_positive_integer():
    for bad in (0, -1):
        with pytest.raises(ValueError):
            ranking.check_k(bad)
    for bad in (True, 1.5, "1"):
        with pytest.raises(TypeError):
            ranking.check_k(bad)


def test_contracts(spark):
    df = scored(spark, [("a", "1", 1.0), ("a", "1", 2.0), ("b", "1", NAN), ("c", None, 1.0), ("d", "1", 1.0), ("d", "2", 1.0)])
    assert {r[0] for r in ranking.score_violations(df).collect()} == {"a", "b", "c"}
    assert {r[0] for r in ranking.incomplete(ranking.rank_scores(df.where("query_id in ('a', 'd')")), 2).collect()} == {"a"}


def test_macro_metrics(spark):
    ranked = spark.createDataFrame([(f"q{q}", f"d{d}", d + 1) for q in range(4) for d in range(6)], "query_id string, document_id string, rank int")
    qrels = spark.createDataFrame([("q0", "d0"), ("q1", "d2"), ("q2", "d1"), ("q2", "d3"), ("q2", "d5"), ("q3", "d5"), ("q0", "d0"), (None, "d1")], "query_id string, document_id string")
    row = metrics.retrieval_metrics(ranked, qrels, 5).first()
    assert (row["ndcg_at_5"], row["recall_at_5"], row["mrr_at_5"], row["queries"]) == (pytest.approx(0.4995473143666032), pytest.approx((1 + 1 + 2 / 3 + 0) / 4), pytest.approx(11 / 24), 4)


def test_recall_counts_all_relevant(spark):
    ranked = spark.createDataFrame([("q", f"d{d}", d + 1) for d in range(6)], "query_id string, document_id string, rank int")
    qrels = spark.createDataFrame([("q", f"d{d}") for d in range(6)], "query_id string, document_id string")
    row = metrics.retrieval_metrics(ranked, qrels, 5).first()
    assert (row["ndcg_at_5"], row["recall_at_5"], row["mrr_at_5"]) == (pytest.approx(1), pytest.approx(5 / 6), 1)


def test_latency_summary(spark):
    df = spark.createDataFrame([(1.0,), (9.0,), (NAN,), (-1.0,), (None,)], "ms double")
    row = samples.latency_summary(df, "ms", 10, 20).first()
    assert (row["samples"], row["p50"], row["documents_per_second"], row["pairs_per_second"]) == (2, 5, 2000, 4000)
    exact = spark.createDataFrame([(x,) for x in (4.0, 1.0, 3.0, 2.0)], "x double").agg(*[F.percentile("x", F.lit(p)).alias(f"p{i}") for i, p in enumerate((0.0, 0.5, 0.95, 1.0))]).first()
    assert list(exact) == pytest.approx([1, 2.5, 3.85, 4])


def test_candidates(spark):
    rows = [("w1", "a", 1.0), ("w1", "b", 1.0), ("w2", "a", 4.0), ("w2", "b", 2.0), ("w1", "c", 0.5)]
    df = spark.createDataFrame(rows, "workload string, candidate string, latency_ms double")
    assert {r["workload"]: r["winner"] for r in samples.workload_winners(df).collect()} == {"w1": "c", "w2": "b"}
    assert [(r["candidate"], r["eligible"]) for r in samples.candidate_ranking(df).orderBy("place").collect()] == [("b", True), ("a", True), ("c", False)]


def test_top_n_limits_groups_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("cast(id % 7 as string) query_id", "cast(id as string) document_id", "cast(id as double) score")
    plan = ranking.rank_scores(df, k=2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_a_complete_ranking_of_a_hot_query_is_many_tasks(spark):
    rows = [("hot", str(i), float(i % 7)) for i in range(3000)] + [("cold", str(i), 1.0) for i in range(20)] + [(None, "x", 1.0), ("nan", "x", float("nan"))]
    df = spark.createDataFrame(rows, "query_id string, document_id string, score double").repartition(5)
    found = {(r["query_id"], r["document_id"]): r["rank"] for r in ranking.rank_scores(df).collect()}
    for q in ("hot", "cold", None):
        own = sorted(((s, d) for x, d, s in rows if x == q), reverse=True)
        assert [found[q, d] for _, d in own] == list(range(1, len(own) + 1))
    assert len(found) == 3021 and ranking.rank_scores(df.where("false")).collect() == []
    parts = ranking.rank_scores(df.where("query_id = 'hot'")).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"
