"""Late interaction, pooling, dense chunks, loss: hand values and a slow oracle."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import dense, loss, maxsim, pooling, ranking

NAN = float("nan")


def tokens(spark, name, items):
    """items: id -> (vectors, mask)."""
    rows = [(i, p, None if m is None else bool(m[p]), [float(x) for x in v]) for i, (vs, m) in items.items() for p, v in enumerate(vs)]
    return spark.createDataFrame(rows, f"{name} string, pos int, mask boolean, emb array<float>")


def scores(spark, queries, documents, width=2, **options):
    q, d = tokens(spark, "query_id", queries), tokens(spark, "document_id", documents)
    return {(r[0], r[1]): r[2] for r in maxsim.maxsim(q, d, width, **options).collect()}


@pytest.mark.parametrize(
    "q, qm, d, dm, expected",
    [
        ([[1, 0], [0, 1]], None, [[1, 0], [0, 2], [-1, 0]], None, 3.0),
        ([[1, 0], [0, 1], [100, 100]], [1, 1, 0], [[1, 0], [0, 2]], None, 3.0),
        ([[1, 0]], None, [[-2, 0], [100, 0]], [1, 0], -2.0),
        ([[1, 0], [NAN, NAN]], [1, 0], [[-2, 0], [NAN, NAN]], [1, 0], -2.0),
        ([[1, 0]], [0], [[1, 0]], None, 0.0),
        ([[1, 0]], None, [[1, 0]], [0], -math.inf),
        ([[1, 0]], [0], [[1, 0]], [0], 0.0),
    ],
)
def test_hand_values(spark, q, qm, d, dm, expected):
    assert scores(spark, {"q": (q, qm)}, {"d": (d, dm)}) == {("q", "d"): expected}


def test_nan_in_an_active_vector_goes_through(spark):
    assert math.isnan(scores(spark, {"q": ([[1, 0]], None)}, {"d": ([[NAN, 0], [1, 0]], None)})[("q", "d")])


def test_all_pairs_in_blocks_of_any_size(spark):
    random = np.random.default_rng(17)
    make = lambda n: {f"{i}": (random.normal(size=(k := random.integers(1, 6), 3)), random.random(k) < 0.7) for i in range(n)}
    queries, documents = make(5), make(7)
    expected = {}
    for a, (qv, qm) in queries.items():
        for b, (dv, dm) in documents.items():
            q, d = qv[qm].astype(np.float32).astype(float), dv[dm].astype(np.float32).astype(float)
            expected[a, b] = 0.0 if not len(q) else -math.inf if not len(d) else sum(max(float(x @ y) for y in d) for x in q)
    for size in (1, 4, 1000):
        found = scores(spark, queries, documents, 3, block_tokens=size)
        assert found.keys() == expected.keys()
        assert all(found[k] == pytest.approx(expected[k], rel=1e-6) for k in expected)


def test_empty_tables_and_repeated_rows(spark):
    empty = tokens(spark, "query_id", {"q": ([[1, 0]], None)}).where("false")
    d = tokens(spark, "document_id", {"d": ([[1, 0]], None)})
    assert maxsim.maxsim(empty, d, 2).collect() == []
    q = tokens(spark, "query_id", {"q": ([[1, 0]], None)})
    assert [r[2] for r in maxsim.maxsim(q.union(q), d.union(d), 2).collect()] == [1.0]


def test_mean_pool(spark):
    items = {"a": ([[1, 0], [0, 1], [5, 5]], [1, 1, 0]), "opposed": ([[1, 0], [-1, 0]], None)}
    pooled = pooling.mean_pool(tokens(spark, "document_id", items), width=2).collect()
    assert [r[0] for r in pooled] == ["a"]
    assert pooled[0][1] == pytest.approx([2**-0.5, 2**-0.5])
    assert [r[0] for r in pooling.without_direction(tokens(spark, "document_id", items), width=2).collect()] == ["opposed"]


def test_dense_chunk_max(spark):
    chunks = spark.createDataFrame([("0", [0.0, 2.0]), ("0", [3.0, 0.0]), ("1", [1.0, 1.0]), ("2", None), (None, [1.0, 0.0])], "document_id string, emb array<float>")
    queries = spark.createDataFrame([("q", [10.0, 0.0]), ("blank", None)], "query_id string, emb array<float>")
    found = {(r[0], r[1]): r[2] for r in dense.scores(queries, chunks, 2, block=1).collect()}
    assert found["q", "0"] == pytest.approx(1) and found["q", "1"] == pytest.approx(2**-0.5) and found["q", "2"] == 0
    assert [found["blank", d] for d in "012"] == [0, 0, 0]


def matrix(spark, rows):
    return spark.createDataFrame([(i, j, float(x)) for i, r in enumerate(rows) for j, x in enumerate(r)], "i int, j int, score double")


def test_loss(spark):
    softplus = lambda x: max(x, 0) + math.log1p(math.exp(-abs(x)))
    rows = {r["i"]: r["loss"] for r in loss.row_loss(matrix(spark, [[4, 1, 3], [2, 5, 4], [0, 2, 1]])).collect()}
    assert [rows[i] for i in range(3)] == pytest.approx([softplus(x) for x in (-1, -1, 1)])
    inf = -math.inf
    mean = loss.reduced_loss(matrix(spark, [[3, 1, inf], [0, 2, inf], [inf, 1, 4]])).first()["mean_loss"]
    assert mean == pytest.approx(sum(map(softplus, (-2, -2, -3))) / 3)
    assert [r["loss"] for r in loss.row_loss(matrix(spark, [[10000, -10000], [10000, -10000]])).orderBy("i").collect()] == [0, 20000]


def test_loss_contract(spark):
    bad = loss.matrix_violations(matrix(spark, [[NAN, 1, 1], [1, math.inf, 1], [-math.inf, -math.inf, 1], [1, 1, 1]]).withColumn("j", F.when(F.col("i") == 3, F.col("j") + 1).otherwise(F.col("j"))))
    assert {r["i"] for r in bad.collect()} == {0, 1, 2}


def test_top1_ties_go_to_the_lowest_column(spark):
    row = loss.ranking_statistics(matrix(spark, [[1, 1], [2, 2]])).first()
    assert row["top1_accuracy"] == 0.5 and row["least_margin"] == 0


def test_the_best_kept_in_tasks_are_the_best_of_all(spark):
    rnd = np.random.default_rng(5)
    rows = [(str(d), p, bool(rnd.random() < 0.8), [float(x) for x in np.round(rnd.normal(size=4), 1)]) for d in range(300) for p in range(d % 4)]
    rows += [("999", 0, True, [float("nan")] * 4)]
    df = spark.createDataFrame(rows, "document_id string, pos int, mask boolean, emb array<float>").repartition(5)
    asked = df.where("cast(document_id as int) < 20").withColumnRenamed("document_id", "query_id")
    for score in (lambda k: maxsim.maxsim(asked, df, 4, block_tokens=7, k=k, digits=1), lambda k: dense.scores(asked.where("pos = 0").select("query_id", "emb"), df, 4, block=3, k=k, digits=1)):
        best = lambda k: {(r[0], r[1], r[2], r["rank"]) for r in ranking.rank_scores(score(k), k=5).collect()}  # noqa: B023, E731
        assert best(5) == best(None)


def test_pooling_of_repeats_and_hot_items(spark):
    rows = [("hot", i, None, [float(i % 3), 1.0]) for i in range(5000)] + [("twice", 0, True, [3.0, 4.0]), ("twice", 0, True, [0.0, 1.0]), ("twice", 0, False, [9.0, 9.0]), ("bad", 0, True, [1.0]), ("hole", 0, True, [None, 1.0]), (None, 0, True, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "document_id string, pos int, mask boolean, emb array<float>")
    runs = [{r[0]: [round(x, 5) for x in r[1]] for r in pooling.mean_pool(df.repartition(n), width=2).collect()} for n in (1, 4, 9)]
    assert runs[0] == runs[1] == runs[2] and runs[0].keys() == {"hot", "twice"} and runs[0]["twice"] == [0.6, 0.8]
    mean = sum(i % 3 for i in range(5000)) / 5000
    assert runs[0]["hot"] == [round(mean / (mean**2 + 1) ** 0.5, 5), round(1 / (mean**2 + 1) ** 0.5, 5)]
