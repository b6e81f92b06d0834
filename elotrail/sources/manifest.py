"""Month manifest of dump files; which months still need loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: dump file name pattern (year, month).
FILE_PATTERN = r"([a-z_]+_(\d{4})-(\d{2})\.pgn\.bz2)\s*$"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A text file of dump URLs, one per line (every line is kept)."""
    return spark.read.text(path).select(F.trim("value").alias("url")).filter(F.col("url") != "")


def select_months(manifest: DataFrame, years=None) -> DataFrame:
    """(year, month, file, url) of the wanted years, oldest first."""
    m = manifest.select(
        F.regexp_extract("url", FILE_PATTERN, 2).try_cast("int").alias("year"),
        F.regexp_extract("url", FILE_PATTERN, 3).try_cast("int").alias("month"),
        F.nullif(F.regexp_extract("url", FILE_PATTERN, 1), F.lit("")).alias("file"),
        "url").filter(F.col("file").isNotNull())
    if years is not None:
        m = m.filter(F.col("year").isin(list(years)))
    return m.orderBy("year", "month")


def pending_months(selected: DataFrame, ledger: DataFrame) -> DataFrame:
    """S3: months of the manifest not in the ledger of loaded files, in order."""
    return selected.join(ledger.select("file"), "file", "left_anti").orderBy("year", "month")


def manifest_from_games(games: DataFrame, prefix: str = "https://example.org/standard/") -> DataFrame:
    """The URL list a loaded ``games`` table corresponds to (one per month)."""
    month = F.date_format("date_time", "yyyy-MM")
    return games.select(F.concat(F.lit(prefix), F.lit("db_standard_rated_"), month,
                                 F.lit(".pgn.bz2")).alias("url")).distinct()
