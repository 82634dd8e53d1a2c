"""Session helpers: table loading, checkpoint folder, bounded driver reads."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir`` (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    Taken from ``spark.checkpoint.dir`` when the session names one.  Only a session without that
    setting (a test on one machine) gets a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if named:
        if not current.isDefined():
            context.setCheckpointDir(named)
        return named
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="foliospark-checkpoint-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(made)
    return made


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the shared checkpoint folder; its lineage is cut and it survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def bounded_rows(df: DataFrame, bound: int, what: str) -> list[Row]:
    """The rows of a table that is small by contract; more than ``bound`` rows raise an error."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what} has more than {bound} rows; it is a parameter table of bounded size")
    return rows


def numbered(df: DataFrame, item: str, number: str) -> DataFrame:
    """``df`` with the rank of each row by ``item`` (distinct values) from 0 on, without sorting all in one task.

    The parts of a range partitioning are numbered each and begin where the ones before end.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = checkpointed(df.repartitionByRange(partitions, item).withColumn("part", F.spark_partition_id()))
    sizes = sorted(tuple(r) for r in parts.groupBy("part").count().collect())
    starts, start = [], 0
    for part, size in sizes:
        starts.append((part, start))
        start += size
    starts = df.sparkSession.createDataFrame(starts, "part int, start bigint")
    place = F.row_number().over(Window.partitionBy("part").orderBy(item)) - 1
    own = [F.col(f"`{c}`") for c in df.columns]
    return parts.withColumn("place_in_part", place).join(F.broadcast(starts), "part").select(*own, (F.col("start") + F.col("place_in_part")).alias(number))


def numbered_within(df: DataFrame, groups: list[str], order: list[Column], number: str) -> DataFrame:
    """``df`` with each row's place in its group from 1 on, in ``order``, which must tell the rows of a group apart.

    Rows are range-partitioned by group and order, numbered in their part, and begin where the parts before end, so
    a group that holds most rows is many tasks.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = checkpointed(df.repartitionByRange(partitions, *groups, *order).withColumn("part_of_range", F.spark_partition_id()))
    keys = [F.col(g).alias(f"group_{i}") for i, g in enumerate(groups)]
    counts = parts.groupBy(*keys, F.col("part_of_range").alias("part_")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*[f"group_{i}" for i in range(len(groups))]).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start_of_part", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = parts.withColumn("place_in_part", F.row_number().over(Window.partitionBy(*groups, "part_of_range").orderBy(*order)))
    same = F.col("part_of_range") == F.col("part_")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"group_{i}"))
    return placed.join(starts, same).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("start_of_part") + F.col("place_in_part")).alias(number))


#: Tables that ``written`` has made in this process and that nothing has deleted yet.
_KEPT: list[str] = []


def written_at(df: DataFrame) -> str:
    """Where ``df`` now lies as a Parquet table under the shared checkpoint folder."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _KEPT.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table under the shared checkpoint folder and read back.

    Like a checkpoint it cuts the lineage and survives lost executors, but it is compressed, and later
    plans prune its columns.  Tables made within ``scratch`` are deleted at its end, all others by ``clear``.
    """
    return df.sparkSession.read.parquet(written_at(df))


def exists(spark: SparkSession, paths: list[str]) -> bool:
    """Whether all these files are there."""
    places = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return all(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in places)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that ``written`` has made, or those after the first ``since`` of them."""
    for path in _KEPT[since:]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del _KEPT[since:]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that are made within are deleted at the end: write or collect the results before it."""
    since = len(_KEPT)
    try:
        yield
    finally:
        clear(spark, since)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where it comes in fewer pieces than there are cores; else as it is."""
    if "Adaptive" in df._jdf.queryExecution().executedPlan().getClass().getSimpleName():
        return df  # it comes out of a shuffle, and asking for its pieces would run that
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
