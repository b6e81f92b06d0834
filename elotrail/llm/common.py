"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` also folds other alphabets)."""
    return F.translate(c, UPPER, LOWER)


def text_of(name: str = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def slots(df: DataFrame, group: str, order: list[str], out: str = "slot") -> DataFrame:
    """Add ``out``: each row's position, gapless from 0, inside its ``group`` in ``order``.

    No group meets in one task: the rows are range-partitioned by (group,
    order), written once (the range bounds come from a sample, so a second
    evaluation could deal differently) with Spark's row id, which counts up
    inside a partition; a table of (partition, group) counts - at most
    partitions + groups rows, hence broadcast - gives each run its offset."""
    from ..operators.stage import cut
    rows = cut(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
               .withColumn("__id", F.monotonically_increasing_id()), "slots")
    pid = F.shiftright("__id", 33)
    runs = (rows.groupBy(pid.alias("__pid"), F.col(group).alias("__g"))
            .agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first")))
    before = W.partitionBy("__g").orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    small = runs.select(F.col("__pid").alias("__rp"), "__g", "__first", "__off")
    hit = rows.join(F.broadcast(small), (pid == F.col("__rp"))
                    & F.col(group).eqNullSafe(F.col("__g")))
    return hit.withColumn(out, F.col("__off") + F.col("__id") - F.col("__first")).drop(
        "__id", "__rp", "__g", "__first", "__off")
