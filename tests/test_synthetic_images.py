"""Synthetic tables, masks, image headers, manifests."""

import struct

import pytest
from pyspark.sql import functions as F

from foliospark.operators import synthetic, validate
from foliospark.sources import files, images


def test_token_table(spark):
    df = synthetic.token_table(spark, 3, 4, 5, 2, 7)
    rows = df.collect()
    assert len(rows) == 12 and all(r["mask"] == (r["pos"] < 2) and len(r["emb"]) == 5 for r in rows)
    assert all(sum(x * x for x in r["emb"]) == pytest.approx(1, abs=1e-5) for r in rows)
    assert df.select(synthetic.cyclic_length(F.col("pos"), 3).alias("n")).distinct().count() == 3
    with pytest.raises(ValueError):
        synthetic.token_table(spark, 1, 2, 3, 3, 0)


def test_masks_and_names(spark):
    df = spark.createDataFrame([(1,), (0,)], "m int")
    assert {r[0] for r in synthetic.mask_from_integers(df, "m").collect()} == {True, False}
    for bad in ((2,), (None,)):
        with pytest.raises(validate.ContractError):
            synthetic.mask_from_integers(spark.createDataFrame([bad], "m int"), "m")
    assert synthetic.named(None, ["a", "b"], "case") == ["a", "b"] and synthetic.named(["b"], ["a", "b"], "case") == ["b"]
    for bad in (["a", "a"], ["z"]):
        with pytest.raises(ValueError):
            synthetic.named(bad, ["a", "b"], "case")


def test_png_headers(spark):
    png = bytes.fromhex(images.PNG_HEAD) + struct.pack(">II", 8, 6) + b"rest"
    df = spark.createDataFrame([(1, bytearray(png)), (2, bytearray(png[:20])), (3, bytearray(b"GIF89a" * 9)), (4, None)], "id int, image binary")
    sizes = {r["id"]: r["size"] and tuple(r["size"]) for r in df.select("id", images.png_size(F.col("image")).alias("size")).collect()}
    assert sizes == {1: (8, 6), 2: None, 3: None, 4: None}
    assert {r["id"]: r["pixels"] for r in images.decode(df, "id", "image", lambda b: [float(len(b))]).collect()} == {1: [28.0], 2: [20.0], 3: [54.0], 4: None}


def test_source_manifest(tmp_path):
    (tmp_path / "a").write_text("x")
    found = files.source_manifest(["b", "a"], str(tmp_path))
    assert found["files"]["b"] is None and len(found["files"]["a"]) == 64
    (tmp_path / "a").write_text("y")
    assert files.source_manifest(["b", "a"], str(tmp_path))["sha256"] != found["sha256"]
