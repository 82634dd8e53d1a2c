"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.tokens import count_tokens
from foliospark.session import bounded_rows, spread, written

#: Cells of the unit interval in which the driver sees a source's tokens, and sources that a mixture may have.
CELLS, SOURCES = 1024, 1_000


@dataclass(frozen=True)
class Weight:
    """A source's share of all tokens and how often one of its records may be used."""

    source: str
    share: float
    cap: int


def weights_of(table: DataFrame) -> list[Weight]:
    """The weights of a table (at most SOURCES rows, checked); rows with a null, no share or no use are left out."""
    rows = bounded_rows(table.select("source", "target_share", "max_repeats"), SOURCES, "the table of weights")
    best = {r[0]: Weight(r[0], float(r[1]), int(r[2])) for r in sorted(rows, key=repr) if None not in (r[0], r[1], r[2]) and r[1] > 0 and r[2] > 0}
    return [best[k] for k in sorted(best)]


def cut_points(rate: float, cap: int) -> list[float]:
    """P(X <= k) of a Poisson variable for k below the cap: a record whose hash exceeds j of them is used j times."""
    term = total = math.exp(-rate)
    cuts = []
    for k in range(cap):
        cuts.append(min(total, 1.0))
        term *= rate / (k + 1)
        total += term
    return cuts


def expected_uses(rate: float, cap: int) -> float:
    """The mean of a Poisson variable of mean ``rate`` that is cut at ``cap``."""
    return sum(1.0 - c for c in cut_points(rate, cap))


def rate_for(uses: float, cap: int) -> float:
    """The mean of the Poisson distribution that, cut at ``cap``, gives ``uses`` on average; for ``cap`` itself, one that always does."""
    low, high = 0.0, 50.0 * cap
    if uses >= cap:
        return high
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if expected_uses(middle, cap) < uses else (low, middle)
    return (low + high) / 2


def used(cells: np.ndarray, cuts: list[float]) -> float:
    """Tokens that come out of a source, given its tokens by cell of the hash."""
    below = np.concatenate(([0.0], np.cumsum(cells)))
    at = np.interp(np.array(cuts) * len(cells), np.arange(len(below)), below)
    return float((below[-1] - at).sum())


def calibrated(cells: np.ndarray, cap: int, target: float) -> list[float]:
    """Cut points of the Poisson distribution whose mean is the target repetition rate, corrected for these hashes.

    The rate is the target over the source's tokens.  What its inversion over the hashes gives differs from the
    target by chance; the rate is corrected, by bisection around it, until the tokens drawn meet the target too.
    """
    whole = float(cells.sum())
    uses = target / whole if whole else 0.0
    rate = rate_for(uses, cap)
    if uses < cap:
        low, high = rate / 8, 8 * rate
        for _ in range(60):
            rate = (low + high) / 2
            low, high = (rate, high) if used(cells, cut_points(rate, cap)) < target else (low, rate)
    return cut_points(rate, cap)


def mix(df: DataFrame, weights: list[Weight], key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 20, total: float | None = None) -> DataFrame:
    """Records replicated so that every source has its share of all tokens: key, source, tokens, copy, text.

    Each record has a number in [0, 1) that is a hash of the seed and the record.  Inverting a Poisson
    distribution at that number gives how often the record comes out, never above its source's cap.  The mean
    of the distribution is set from the sources' tokens by cell of the hash (a table bounded by the weights), so
    that the tokens drawn, not just expected, meet the target.  Copies are spread by a hash of their own
    over all partitions and in random order within them.

    ``total`` is the number of tokens wanted; by default the most that the caps allow at these shares, at which the
    scarcest source gives every record as often as it may.
    Where a source can't fill its share within its cap it comes out as often as allowed.  Sources without a
    weight, or with a null one, are left out; the shares of sources without tokens go to the others in
    proportion.  Null and empty texts have no tokens and, like all records, are drawn by their hash.  The
    result doesn't depend on partitioning.  Repeated rows are records of their own that share a hash.
    """
    spark = df.sparkSession
    names = [w.source for w in weights]
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").alias("text")).where(F.col("source").isin(names))
    sign = F.xxhash64(F.lit(seed), "key", "source", F.xxhash64("text"))
    rows = written(count_tokens(spread(rows), text="text").withColumn("at", F.shiftrightunsigned(sign, 11) / F.lit(float(2**53))))
    cells: dict[str, np.ndarray] = {w.source: np.zeros(CELLS) for w in weights}
    for r in rows.groupBy("source", F.floor(F.col("at") * CELLS).cast("int").alias("cell")).agg(F.sum("tokens").alias("tokens")).collect():
        cells[r["source"]][r["cell"]] = r["tokens"]
    present = [w for w in weights if cells[w.source].sum() > 0]
    shares = {w.source: w.share / sum(p.share for p in present) for w in present}
    if total is None:
        total = min((float(w.cap * cells[w.source].sum() / shares[w.source]) for w in present), default=0.0)
    cuts = {w.source: calibrated(cells[w.source], w.cap, shares[w.source] * total) for w in present}
    plan = spark.createDataFrame([(s, c) for s, c in sorted(cuts.items())], "source string, cuts array<double>")
    drawn = rows.join(F.broadcast(plan), "source").withColumn("uses", F.size(F.filter("cuts", lambda c: F.col("at") > c)))
    copies = drawn.where("uses > 0").select("key", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy"), "text")
    copies = copies.withColumn("order", F.xxhash64(F.lit(seed + 1), "key", "source", F.xxhash64("text"), "copy"))
    mixed = copies.repartition("order").sortWithinPartitions("order")
    return mixed.select(F.col("key").alias(key), F.col("source").alias(source), "tokens", "copy", F.col("text").alias(text))


def shares(mixed: DataFrame, weights: list[Weight], source: str = "source") -> DataFrame:
    """What was reached: source, target_share, tokens, share, shortfall, records (with copies) and the most uses of one."""
    spark = mixed.sparkSession
    targets = spark.createDataFrame([(w.source, w.share, w.cap) for w in weights], "source string, target_share double, max_repeats int")
    got = mixed.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("records"), F.max("copy").alias("most_uses"))
    both = targets.join(got, "source", "left").fillna(0, ["tokens", "records", "most_uses"])
    everything = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return both.withColumn("share", F.when(everything > 0, F.col("tokens") / everything).otherwise(F.lit(0.0))).withColumn("shortfall", F.greatest(F.col("target_share") - F.col("share"), F.lit(0.0)))
