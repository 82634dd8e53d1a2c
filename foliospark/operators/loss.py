"""Hardest-in-batch contrastive loss as an aggregate over a score matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.numeric import is_finite, softplus


def matrix_violations(matrix: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (``i``) of a matrix (i, j, score), or of one for each ``by``, that the loss can't take.

    Each row needs a finite diagonal, no NaN or +inf, and a finite entry beside the diagonal.
    """
    other = F.col("i") != F.col("j")
    rows = matrix.groupBy(*by, "i").agg(
        F.count_if(~other & is_finite(F.col("score"))).alias("diagonal"),
        F.count_if(F.col("score").isNull() | F.isnan("score") | (F.col("score") == float("inf"))).alias("bad"),
        F.count_if(other & is_finite(F.col("score"))).alias("negatives"),
    )
    return rows.where("diagonal <> 1 or bad > 0 or negatives = 0").select(*by, "i")


def row_loss(matrix: DataFrame) -> DataFrame:
    """For each row i: positive, hardest negative and softplus(negative - positive); -inf negatives don't count."""
    other = F.col("i") != F.col("j")
    rows = matrix.groupBy("i").agg(F.max(F.when(~other, F.col("score"))).alias("positive"), F.max(F.when(other & (F.col("score") != float("-inf")), F.col("score"))).alias("negative"))
    return rows.withColumn("loss", softplus(F.col("negative") - F.col("positive")))


def reduced_loss(matrix: DataFrame) -> DataFrame:
    """One row: mean and sum of the loss."""
    return row_loss(matrix).agg(F.avg("loss").alias("mean_loss"), F.sum("loss").alias("sum_loss"), F.count(F.lit(1)).alias("rows"))


def ranking_statistics(matrix: DataFrame) -> DataFrame:
    """One row: how often the diagonal is the row's maximum (ties to the lowest column), and the least margin."""
    best = matrix.groupBy("i").agg(F.max(F.struct("score", (-F.col("j")).alias("j"))).alias("top"))
    rows = row_loss(matrix).join(best, "i")
    return rows.agg(F.avg((-F.col("top.j") == F.col("i")).cast("double")).alias("top1_accuracy"), F.min(F.col("positive") - F.col("negative")).alias("least_margin"))
