"""Query results to CSV (header) and back with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import cumulative_before
from ..operators.stage import cut


def run_queries(spark: SparkSession, sqls, out_dir: str, names=None) -> dict[str, str]:
    """Run SQL statements and write each result as CSV with a header under
    ``out_dir/<name>``; default names ``results_<i>``.  What a statement orders is in this order
    when the files are read by name."""
    if isinstance(sqls, str):
        sqls = [sqls]
    sqls = list(sqls)
    if names is None:
        names = [f"results_{i}" for i in range(len(sqls))]
    elif len(names) != len(sqls):
        raise ValueError("number of names differs from number of queries")
    out = {}
    for sql, name in zip(sqls, names):
        path = f"{out_dir.rstrip('/')}/{name}"
        spark.sql(sql).write.mode("overwrite").option("header", True).csv(path)
        out[name] = path
    return out


def write_result(df: DataFrame, path: str, order=()) -> str:
    """Write a result as CSV with a header in every file.

    ``order`` (columns, or sort expressions such as the lower bound of a bracket): the rows are
    sorted in total, by ranges over many tasks; file numbers ascend with them, so reading
    the files by name gives the rows in order (O1, O3)."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_ordered(spark: SparkSession, path: str, schema: T.StructType, position: str = "position") -> DataFrame:
    """A result as ``read_result`` gives it, with each row's place in the export, from 1: by the
    number of its file, then by its line."""
    rows = read_result(spark, path, schema)
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    rows = cut(rows.select("*", part.alias("_part"), F.col("_metadata.file_block_start").alias("_block"),
                           F.monotonically_increasing_id().alias("_line")), "export")
    placed = cumulative_before(rows, [], ["_part", "_block", "_line"])
    return placed.select((F.col("_before") + 1).alias(position), *schema.fieldNames())


def read_result(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a CSV result (plain or compressed) with an explicit schema."""
    return spark.read.schema(schema).option("header", True).csv(path)
