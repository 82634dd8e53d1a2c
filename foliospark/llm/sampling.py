"""A reproducible sample that is stable as data grows: golden-ratio selection over persistent sequence numbers."""

from __future__ import annotations

import hashlib
from decimal import Decimal, getcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import bounded_rows, checkpointed, numbered_within

getcontext().prec = 60
GOLDEN = (Decimal(5).sqrt() - 1) / 2
#: A sequence number is taken apart here, so that its multiple keeps its fraction in double precision.
LOW = 1 << 24
#: Size of a stratum for which a selection is planned, as a multiple of its size after its founding stretch:
#: when it has grown that far the sample has its target, before it has less and afterwards more, in proportion.
PLANNED = 2.0
#: Specifications that a selection may have.
SPECIFICATIONS = 200


def golden_fraction(number: Column, shift: Column | float) -> Column:
    """The fraction of ``number`` times the golden ratio, shifted."""
    high, low = F.floor(number / F.lit(LOW)), number % F.lit(LOW)
    part = low * F.lit(float(GOLDEN)) + high * F.lit(float(GOLDEN * LOW % 1)) + (F.lit(shift) if isinstance(shift, float) else shift)
    return part - F.floor(part)


def shift_of(*names: str) -> float:
    """A fixed number in [0, 1) for the names."""
    return int.from_bytes(hashlib.sha256("\0".join(names).encode()).digest()[:6], "big") / 2**48


def arrivals(df: DataFrame, stratum: str, item: str, arrival: Column, then: Column | None = None) -> DataFrame:
    """Each item of a stratum once: stratum, item, arrival (the first; null if any row lacks it), then, sign (a hash of the item).

    Rows without a stratum or an item are left out.
    """
    rows = df.select(
        F.col(f"`{stratum}`").cast("string").alias("stratum"), F.col(f"`{item}`").cast("string").alias("item"),
        arrival.cast("double").alias("arrival"), (F.lit(None) if then is None else then).cast("double").alias("then"),
    ).where("stratum is not null and item is not null")
    first = F.min(F.struct(F.col("arrival").isNotNull(), "arrival", "then"))
    return rows.groupBy("stratum", "item").agg(first.alias("first")).select("stratum", "item", "first.arrival", "first.then", F.sha2("item", 256).alias("sign"))


def numbered(items: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """``arrivals`` with ``number``: from 1 on in order of arrival, ``then`` and hash within the stratum.

    With ``taken`` (stratum, most) numbers go on from the greatest taken one.  An item whose arrival isn't known has
    no place in that order; its number is drawn from its hash, so that it moves no other item and none moves it.

    The order is made by a range partitioning of all items, so that a stratum that holds most items is many tasks.
    """
    order = [F.col(c) for c in ("arrival", "then", "sign", "item")]
    placed = numbered_within(items.where("arrival is not null"), ["stratum"], order, "number")
    if taken is not None:
        placed = placed.join(taken, "stratum", "left").withColumn("number", F.col("number") + F.coalesce("most", F.lit(0)))
    drawn = items.where("arrival is null").withColumn("number", F.conv(F.substring("sign", 1, 12), 16, 10).cast("bigint"))
    columns = ["stratum", "item", "arrival", "number"]
    return placed.select(*columns).unionByName(drawn.select(*columns))


def founding_sizes(items: DataFrame, span: float) -> DataFrame:
    """stratum, founding: how many items came within ``span`` of the stratum's first arrival; all, if no arrival is known.

    For items of the strata of at most SPECIFICATIONS selections.
    """
    by_arrival = items.groupBy("stratum", "arrival").agg(F.count(F.lit(1)).alias("n"))
    firsts = by_arrival.groupBy("stratum").agg(F.min("arrival").alias("first"), F.sum("n").alias("all"))
    early = by_arrival.join(F.broadcast(firsts), "stratum").where(F.col("first").isNull() | (F.col("arrival") <= F.col("first") + F.lit(float(span))))
    return early.groupBy("stratum").agg(F.sum("n").alias("founding"))


def plan(spark: SparkSession, wanted: list[tuple[str, str, int]], kind: str, sizes: DataFrame, planned: float) -> DataFrame:
    """stratum, salt, kind, target, shift and width of each selection: the fixed interval, target over planned size."""
    rows = [(stratum, salt, kind, target, shift_of(salt, kind, stratum)) for stratum, salt, target in wanted]
    if len(rows) > SPECIFICATIONS:
        raise ValueError(f"more than {SPECIFICATIONS} specifications")
    table = spark.createDataFrame(rows, "stratum string, salt string, kind string, target bigint, shift double")
    return table.join(sizes, "stratum").select(*table.columns, (F.col("target") / (F.lit(planned) * F.col("founding"))).alias("width"))


def select(numbers: DataFrame, plans: DataFrame) -> DataFrame:
    """The items whose fraction falls in a plan's interval, for all plans (at most SPECIFICATIONS) at once: stratum, salt, kind, item."""
    chosen = numbers.select("stratum", "item", "number").join(F.broadcast(plans), "stratum").where(golden_fraction(F.col("number"), F.col("shift")) < F.col("width"))
    return chosen.select("stratum", "salt", "kind", "item")


def stable_sample(df: DataFrame, stratum: str, item: str, arrival: Column, wanted: list[tuple[str, str, int]], kind: str, span: float = 0.0, then: Column | None = None, planned: float = PLANNED) -> DataFrame:
    """A sample for each (stratum, salt, target) of ``wanted``, from the table alone: stratum, salt, kind, item.

    Items are numbered within their stratum in order of ``arrival`` (a number), ``then`` and a hash.  Item number s
    is selected if the fraction of s times the golden ratio, shifted by an amount that the salt fixes, falls in a
    fixed interval.  Consecutive numbers spread evenly over [0, 1), so every stretch of the data is covered evenly.
    The interval is the target over the planned size: ``planned`` times what came within ``span`` of the
    stratum's first arrival, which later arrivals don't change.

    So numbers and intervals persist as long as what arrives later has a later (arrival, then): whole batches, or
    parts of one in order of ``then``.  ``NumberBook`` keeps both in a table, for arrivals in any order.

    The result doesn't depend on order or partitioning.  Items delivered again count once, by their first
    arrival; an item with a row whose arrival is null is numbered by its hash and moves no other.  Null strata and
    items are left out.  A target of 0, or a stratum without items, gives nothing; one above the planned size all.
    """
    spark = df.sparkSession
    strata = F.broadcast(spark.createDataFrame([(s,) for s in sorted({w[0] for w in wanted})], "stratum string"))
    items = checkpointed(arrivals(df, stratum, item, arrival, then).join(strata, "stratum", "left_semi"))
    return select(numbered(items), plan(spark, wanted, kind, founding_sizes(items, span), planned))


class NumberBook:
    """Numbers and intervals kept in tables of a shared folder: what was selected stays, whatever arrives in whatever order.

    ``numbers`` has a row an item, ``plans`` one a selection; both only grow.  Each addition is a folder of its own,
    so one that was cut off can be taken back (``open`` reads what ``add`` has finished).
    """

    def __init__(self, spark: SparkSession, path: str, kind: str, planned: float = PLANNED):
        self.spark, self.path, self.kind, self.planned = spark, path.rstrip("/"), kind, planned

    def _stages(self, what: str) -> list[str]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(place):
            return []
        names = sorted(s.getPath().getName() for s in files.listStatus(place))
        return [f"{self.path}/{what}/{n}" for n in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}/{n}/_SUCCESS"))]

    def _open(self, what: str, schema: str) -> DataFrame:
        stages = self._stages(what)
        return self.spark.read.schema(schema).parquet(*stages) if stages else self.spark.createDataFrame([], schema)

    def _append(self, what: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{what}/{len(self._stages(what)):08d}")

    @property
    def numbers(self) -> DataFrame:
        """stratum, item, arrival, number."""
        return self._open("numbers", "stratum string, item string, arrival double, number bigint")

    @property
    def plans(self) -> DataFrame:
        """stratum, salt, kind, target, shift, width."""
        return self._open("plans", "stratum string, salt string, kind string, target bigint, shift double, width double")

    def add(self, df: DataFrame, stratum: str, item: str, arrival: Column, then: Column | None = None) -> None:
        """Number the items that the book lacks, after all it has; those it has keep their number."""
        held = self.numbers
        new = arrivals(df, stratum, item, arrival, then).join(held, ["stratum", "item"], "left_anti")
        most = held.where("arrival is not null").groupBy("stratum").agg(F.max("number").alias("most"))
        self._append("numbers", numbered(checkpointed(new), most))

    def select(self, wanted: list[tuple[str, str, int]]) -> DataFrame:
        """The sample of each (stratum, salt, target): a selection met for the first time is planned by its stratum's size now, and kept."""
        known = {(r["stratum"], r["salt"]) for r in bounded_rows(self.plans, SPECIFICATIONS, "the table of plans")}
        fresh = [w for w in wanted if (w[0], w[1]) not in known]
        if fresh:
            sizes = self.numbers.groupBy("stratum").agg(F.count(F.lit(1)).alias("founding"))
            self._append("plans", plan(self.spark, fresh, self.kind, sizes, self.planned))
        names = self.spark.createDataFrame([(s, salt) for s, salt, _ in wanted], "stratum string, salt string")
        return select(self.numbers, self.plans.join(F.broadcast(names.distinct()), ["stratum", "salt"], "left_semi"))


def wanted_of(specs: DataFrame, target: str) -> list[tuple[str, str, int]]:
    """The (task, salt, target) of a table of selections (at most SPECIFICATIONS rows, checked); rows with a null are left out."""
    rows = bounded_rows(specs.select("task", "salt", target), SPECIFICATIONS, "the table of selections")
    return sorted({(r[0], r[1], int(r[2])) for r in rows if None not in (r[0], r[1], r[2]) and r[2] > 0})
