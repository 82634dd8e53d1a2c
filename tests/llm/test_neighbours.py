"""Nearest vectors: the curve, and the search against brute force."""

import numpy as np
import pytest

from foliospark.llm import neighbours

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_each_cell_and_steps_to_a_neighbour(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = neighbours.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    path = cells[np.argsort(keys)].astype(int)
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_squeezed_vectors_keep_their_cosines():
    v = neighbours.unit(np.random.default_rng(1).normal(size=(200, 33)).astype(np.float32))
    back = neighbours.unsqueeze(neighbours.squeeze(v))[:, :33]
    assert np.abs(back @ back.T - v @ v.T).max() < 5e-4


def clustered(n, width, seed=2):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(n // 12, width))
    v = centres[rnd.integers(0, len(centres), n)] + rnd.normal(size=(n, width)) * rnd.uniform(0.1, 0.9, (n, 1))
    return v.astype(np.float32)


def brute(names, vectors, k, least, owners=None):
    v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    s = v @ v.T
    np.fill_diagonal(s, -2)
    if owners is not None:
        s[np.array(owners)[:, None] == np.array(owners)[None, :]] = -2
    top = np.argsort(-s, axis=1)[:, :k]
    return {(names[i], names[j]) for i in range(len(names)) for j in top[i] if s[i, j] >= least}


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], o) for i, v, o in rows], "item string, vector array<float>, id string").repartition(4)


def test_recall(spark):
    v = clustered(3000, 32)
    names = [str(i) for i in range(len(v))]
    df = frame(spark, [(n, x, n) for n, x in zip(names, v)])
    found = {(r[0], r[1]) for r in neighbours.nearest(df, "item", "vector", width=32, window=256).collect()}
    truth = brute(names, v, 5, 0.8)
    assert len(truth) > 3000 and len(found & truth) >= 0.97 * len(truth) and len(found & truth) >= 0.97 * len(found)


def test_copies_bad_vectors_and_repeats(spark):
    base = clustered(60, 8)
    rows = [(f"u{i}", x, "x") for i, x in enumerate(base)]
    rows += [(f"c{i:03}", base[0], "x") for i in range(300)]  # a third and more of all rows are copies
    rows += [("null", None, "x"), ("zero", [0] * 8, "x"), ("short", [1] * 7, "x"), ("nan", [NAN] + [1] * 7, "x"), ("inf", [INF] + [1] * 7, "x"), ("hole", [None] + [1] * 7, "x"), (None, base[1], "x")]
    rows += rows[:5]
    df = frame(spark, rows)
    found = {}
    for r in neighbours.nearest(df, "item", "vector", width=8, dims=6).collect():
        found.setdefault(r["item"], []).append((r["place"], r["neighbour"]))
    found = {k: [n for _, n in sorted(v)] for k, v in found.items()}
    assert not {"null", "zero", "short", "nan", "inf", "hole", None} & set(found)
    assert found["u0"] == ["c299", "c298", "c297", "c296", "c295"]
    assert found["c299"] == ["u0", "c298", "c297", "c296", "c295"] and found["c000"] == ["u0", "c299", "c298", "c297", "c296"]
    names = [f"u{i}" for i in range(1, 60)]
    for a, b in brute(names, base[1:], 1, 0.8):
        assert b in found[a] or "u0" in found[a]  # else copies of u0 fill the list
    assert all(len(v) <= 5 and len(set(v)) == len(v) and k not in v for k, v in found.items())


def test_owners_and_empty(spark):
    v = clustered(400, 16)
    names, owners = [str(i) for i in range(400)], [str(i // 4) for i in range(400)]
    df = frame(spark, list(zip(names, v, owners)))
    found = {(r[0], r[1]) for r in neighbours.nearest(df, "item", "vector", width=16, owner="id", window=400).collect()}
    truth = brute(names, v, 5, 0.8, owners)
    assert len(found & truth) >= 0.99 * len(truth)
    assert all(owners[int(a)] != owners[int(b)] for a, b in found)
    assert neighbours.similar_pairs(df.where("false"), "item", "vector", width=16).collect() == []


def test_recall_on_a_hot_topic_does_not_depend_on_partitions(spark):
    rnd = np.random.default_rng(3)
    themes = rnd.normal(size=(150, 64))
    v = (2.4 * rnd.normal(size=64) + 0.6 * themes[rnd.integers(0, 150, 3000)] + 0.8 * rnd.normal(size=(3000, 64))).astype(np.float32)
    names = [str(i) for i in range(len(v))]
    truth = brute(names, v, 5, 0.8)
    df = frame(spark, [(n, x, n) for n, x in zip(names, v)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for partitions, options in (("64", {}), ("4", {}), ("4", {"range_rows": 1024})):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            found.append({(r[0], r[1]) for r in neighbours.nearest(df, "item", "vector", width=64, window=128, **options).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
    assert all(len(f & truth) >= 0.9 * len(truth) for f in found)


def test_neighbouring_ranges_share_a_window():
    keys = np.random.default_rng(4).permutation(10_000)
    cuts, ends = neighbours.cuts_of(keys, 1.0, 2_500, 100)
    assert list(cuts) == [2_500, 5_000, 7_500] and list(ends) == [2_600, 5_100, 7_600]
    sample = keys[:1_000]
    cuts, ends = neighbours.cuts_of(sample, 0.1, 2_500, 100)
    assert len(cuts) in (3, 4) and (ends - cuts >= 100).all()
