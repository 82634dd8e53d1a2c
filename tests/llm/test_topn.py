"""Top N within groups, against a plain computation."""

import random
from collections import defaultdict

from foliospark.llm import topn

NAN, INF = float("nan"), float("inf")


def plain(rows, limit):
    best = defaultdict(dict)
    for g, i, s in rows:
        if i is not None and s is not None and s == s and abs(s) != INF:
            best[g][i] = max(s, best[g].get(i, -INF))
    return {(g, p + 1, i) for g, d in best.items() for p, (i, _) in enumerate(sorted(d.items(), key=lambda x: (x[1], x[0]), reverse=True)[:limit])}


def run(spark, rows, limit, parts=5, **options):
    df = spark.createDataFrame([(g, i, s, limit, "clash") for g, i, s in rows], "g string, i string, s double, k int, item string").repartition(parts)
    return {(r["g"], r["place"], r["i"]) for r in topn.top_n(df, ["g"], "i", "s", "k", **options).collect()}


def test_skewed_groups_ties_and_repeats(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.4 else f"g{rnd.randrange(60)}", str(rnd.randrange(300)), rnd.choice([0.0, -0.0, 1.0, 2.5, -3.0, NAN, INF, -INF, None])) for _ in range(6000)]
    rows += rows[:500] + [(None, "1", 1.0), (None, None, 2.0)]
    for options in ({}, {"buffer_rows": 50, "state_rows": 40}):
        assert run(spark, rows, 7, **options) == plain(rows, 7)
    assert run(spark, rows, 7, parts=1) == plain(rows, 7)


def test_ids_compare_by_code_point(spark):
    rows = [("g", i, 1.0) for i in ("9", "10", "é", "z", "\U0001f600", "￿", "")]
    assert run(spark, rows, 10) == plain(rows, 10)


def test_empty_and_limits(spark):
    assert run(spark, [("g", "1", 1.0)], 0) == set()
    empty = spark.createDataFrame([], "g string, i string, s double, k int")
    assert topn.top_n(empty, ["g"], "i", "s", "k").collect() == []
    scores = spark.createDataFrame([("a", "q", 1.0), ("b", "q", 1.0), (None, "q", 1.0)], "scorer string, d string, score double")
    limits = spark.createDataFrame([("a", 2), ("a", 3), ("c", 1), (None, 1), ("b", None)], "scorer string, k int")
    assert [(r["scorer"], r["limit_of_scorer"]) for r in topn.with_limits(scores, limits).collect()] == [("a", 3)]
