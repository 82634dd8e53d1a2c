"""The score matrix of the loss has all pages as columns."""

from foliospark import queries
from foliospark.session import numbered


def test_numbers_follow_the_order(spark):
    ids = [str(i) for i in range(500)]
    found = numbered(spark.createDataFrame([(i,) for i in ids], "id string").repartition(3), "id", "n").collect()
    assert {r["id"]: r["n"] for r in found} == {x: n for n, x in enumerate(sorted(ids))}


def test_negatives_come_from_all_pages(spark, tmp_path):
    def unit(*x):
        return [float(v) for v in x] + [0.0] * (128 - len(x))

    rows = [("20", 0, True, unit(1)), ("40", 0, True, unit(0, 1)), ("7", 0, True, unit(0.8, 0.6)), ("3", 0, True, unit(0, 0, 1))]
    spark.createDataFrame(rows, "document_id string, pos int, mask boolean, embedding array<float>").write.parquet(f"{tmp_path}/doc_tok.parquet")
    rows = {r["i"]: (round(r["positive"], 3), round(r["negative"], 3)) for r in queries.loss_per_row(spark, str(tmp_path)).collect()}
    assert rows == {0: (1.0, 0.8), 2: (1.0, 0.6)}  # in order: 20, 3, 40, 7
