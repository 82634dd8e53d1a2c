"""The stable sample."""

import random

from pyspark.sql import functions as F

from foliospark.llm import sampling

WANTED = [("hot", "salt", 60), ("cold", "salt", 20), ("hot", "päges", 60), ("absent", "s", 5)]


def rows(n=3000):
    rnd = random.Random(8)
    sizes = [0.4, 0.2, 0.2, 0.1, 0.1]
    return [("hot" if i % 4 else "cold", str(i), rnd.choices(range(1, 6), sizes)[0], "x") for i in range(n)]


def run(spark, data, parts=3):
    df = spark.createDataFrame(data, "task string, id string, batch int, number string").repartition(parts)
    found = sampling.stable_sample(df, "task", "id", F.col("batch"), WANTED, "document").collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


def widths(data):
    """The fixed interval of each selection: the target over twice the first batch."""
    first = {}
    for task, item, batch, _ in data:
        first.setdefault(task, {}).setdefault(item, []).append(batch)
    founding = {t: sum(min(b) == 1 for b in items.values()) for t, items in first.items()}
    return {(t, salt): target / (2 * founding[t]) for t, salt, target in WANTED[:3]}


def test_same_in_every_run_and_kept_as_batches_come(spark):
    data = rows()
    whole = run(spark, data)
    assert whole == run(spark, list(reversed(data)), 8)
    held = set()
    for batch in range(1, 6):
        now = [r for r in data if r[2] <= batch]
        found = run(spark, now)
        assert held <= found
        held = found
        for (task, salt), width in widths(data).items():
            size = sum(1 for r in found if r[0] == task and r[1] == salt)
            assert abs(size - width * sum(r[0] == task for r in now)) <= 3  # an even share of every stretch
    assert {r[3] for r in held if r[1] == "salt" and r[0] == "hot"} != {r[3] for r in held if r[1] == "päges"}


def test_parts_of_a_batch_by_time_and_unknown_arrivals_are_kept(spark):
    rnd = random.Random(3)
    data = [("hot", str(i), b, rnd.random()) for i, (_, _, b, _) in enumerate(rows(2000))] + [("hot", f"n{i}", None, None) for i in range(300)]
    sample = lambda keep: {r["item"] for r in sampling.stable_sample(
        spark.createDataFrame([r for r in data if keep(*r[1:])], "task string, id string, batch int, at double"), "task", "id", F.col("batch"), [("hot", "s", 100)], "document", then=F.col("at"),
    ).collect()}
    whole = sample(lambda i, b, t: True)
    for keep in (lambda i, b, t: b is not None, lambda i, b, t: b is None or b < 3 or b == 3 and t < 0.5, lambda i, b, t: b == 1 or b is None and i < "n2"):
        assert sample(keep) <= whole
    assert 100 <= len(whole) <= 160 and any(i.startswith("n") for i in whole)


def test_a_book_keeps_all_whatever_comes_in_whatever_order(spark, tmp_path):
    data = [(t, i, b) for t, i, b, _ in rows(2000)] + [("hot", f"n{i}", None) for i in range(100)]
    random.Random(5).shuffle(data)
    book, held, wanted = sampling.NumberBook(spark, str(tmp_path), "document"), set(), WANTED[:3]
    for turn, part in enumerate((data[:700], data[700:900], data[:900], [], data[900:])):  # any split, one repeated, one empty
        book.add(spark.createDataFrame(part, "task string, id string, batch int"), "task", "id", F.col("batch"))
        now = {tuple(r) for r in sampling.NumberBook(spark, str(tmp_path), "document").select(wanted[: 2 if turn == 0 else 3]).collect()}
        assert held <= now and now
        held = now
    numbers = book.numbers.where("arrival is not null").collect()
    assert len({(r["stratum"], r["item"]) for r in numbers}) == len(numbers) == 2000
    for task in ("hot", "cold"):
        own = sorted(r["number"] for r in numbers if r["stratum"] == task)
        assert own == list(range(1, len(own) + 1))
    assert book.plans.count() == 3 and book.select([("absent", "s", 5)]).collect() == []


def test_repeats_nulls_and_empty(spark):
    data = rows(600)
    assert run(spark, data + [(t, i, b + 1, "y") for t, i, b, _ in data[:200]] + [(None, "1", 1, "x"), ("hot", None, 1, "x")]) == run(spark, data)
    assert run(spark, [("hot", "1", None, "x")]) in (set(), {("hot", "salt", "document", "1")}, {("hot", "päges", "document", "1")}, {("hot", "salt", "document", "1"), ("hot", "päges", "document", "1")})
    df = spark.createDataFrame([], "task string, id string, batch int")
    assert sampling.stable_sample(df, "task", "id", F.col("batch"), WANTED, "document").collect() == []


def test_coverage_is_even(spark):
    df = spark.range(1, 2001).select(sampling.golden_fraction(F.col("id"), 0.3).alias("f"))
    values = sorted(r[0] for r in df.collect())
    gaps = [b - a for a, b in zip(values, values[1:])]
    assert max(gaps) < 3 / 2000 and all(0 <= v < 1 for v in values)
    far = spark.createDataFrame([(10**15,), (10**15 + 1,)], "id bigint").select(sampling.golden_fraction(F.col("id"), 0.0)).collect()
    assert abs((far[1][0] - far[0][0]) % 1 - float(sampling.GOLDEN)) < 1e-6


def test_wanted(spark):
    specs = spark.createDataFrame([("a", "s", 3), (None, "s", 3), ("b", None, 3), ("c", "s", None), ("d", "s", 0)], "task string, salt string, n int")
    assert sampling.wanted_of(specs, "n") == [("a", "s", 3)]
