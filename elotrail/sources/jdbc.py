"""Parallel JDBC scans.

No database runs in this environment, so these readers are not exercised by
the tests or registered queries (see README)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int = 64,
              properties: dict | None = None) -> DataFrame:
    """Partitioned JDBC read: ``numPartitions`` range queries on
    ``partition_column`` (instead of one connection plus a repartition).
    ``table`` may be a parenthesised sub-query with an alias (S5)."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions))
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    return r.load()
