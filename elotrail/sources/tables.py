"""The ``games`` fact table and ``user_ids`` dimension.

In production both are Parquet tables written by the ingest
(:mod:`elotrail.plans.ingest`).  For the test tables shipped with the
environment (``orders`` / ``customer``) a deterministic adapter derives the
same shape; the formula is the fixed contract of ``FIXTURES.md`` §2, so the
same rows can be produced independently by the SQL oracle.

The adapter is a narrow projection of ``orders`` (no shuffle); the only
non-local input is the customer count, planned as a scalar sub-query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import GAMES_COLUMNS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


#: declared columns of the tables that the adapter reads (no schema job per call)
READ_SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz",
    "customer": "c_custkey long, c_name string"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in READ_SCHEMAS:
        reader = reader.schema(READ_SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _code(x: Column, mod: int, cases: list[tuple[int, str]], other: str) -> Column:
    """``x mod m`` mapped through ascending upper limits (exclusive)."""
    r = x % F.lit(mod)
    out = None
    for lim, val in cases:
        out = F.when(r < lim, val) if out is None else out.when(r < lim, val)
    return out.otherwise(other)


def _elo(player0: Column, k: Column, d: Column) -> Column:
    base = F.lit(560) + (player0 * 97) % 2350
    drift = F.floor(d * (player0 % 9 - 2) / F.lit(50.0))
    noise = (k * 31) % 41 - 20
    return (base + drift + noise).cast("int")


def _title(player0: Column) -> Column:
    r = player0 % 40
    return F.when(r == 0, F.lit("GM")).when(r == 1, F.lit("BOT"))


def games_from_orders(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Derive ``games`` rows from ``orders`` (fixed adapter of FIXTURES §2)."""
    n = customer.select(F.count(F.lit(1))).scalar()
    k, w = F.col("o_orderkey"), F.col("o_custkey")
    b = (w + 1 + (k * 7) % (n - 1)) % n
    d = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    src = orders.select(k.alias("k"), w.alias("w"), b.alias("b"), d.alias("d"),
                        F.col("o_orderdate").alias("od"))
    k, w, b, d = F.col("k"), F.col("w"), F.col("b"), F.col("d")
    res = k % 7
    term = k % 50
    out = src.select(
        _code(k, 20, [(10, "B"), (15, "b"), (17, "c"), (19, "R")], "C").alias("event"),
        F.lpad(k.cast("string"), 8, "0").alias("site"),
        (w + 1).cast("int").alias("white"),
        (b + 1).cast("int").alias("black"),
        F.when(res == 0, "D").when(res <= 3, "W").otherwise("B").alias("result"),
        _elo(w, k, d).alias("whiteelo"),
        _elo(b, k, d).alias("blackelo"),
        ((k * 37) % 79 - 39).cast("int").alias("whiteratingdiff"),
        (39 - (k * 41) % 79).cast("int").alias("blackratingdiff"),
        _code(k, 3, [(1, "B01"), (2, "C20")], "A00").alias("eco"),
        (60 + (k % 10) * 60 + 40 * (k % 5)).cast("int").alias("timecontrol"),
        F.when(term == 0, "A").when(term == 1, "?").when(term < 18, "F").otherwise("N")
         .alias("termination"),
        _title(w).alias("whitetitle"),
        _title(b).alias("blacktitle"),
        (k % 9 == 0).alias("analyzed"),
        (F.col("od") + F.make_dt_interval(secs=((k * 7919) % 86400).cast("int")))
        .cast("timestamp_ntz").alias("date_time"),
    )
    return out.select(*GAMES_COLUMNS)


def users_from_customer(customer: DataFrame) -> DataFrame:
    return customer.select((F.col("c_custkey") + 1).cast("int").alias("id"),
                           F.col("c_name").alias("username"))


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``games`` fact table for a directory of driver tables."""
    return games_from_orders(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))


def user_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``user_ids`` dimension for a directory of driver tables."""
    return users_from_customer(table(spark, sf_dir, "customer"))


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Make ``games`` and ``user_ids`` addressable from ``spark.sql``."""
    games(spark, sf_dir).createOrReplaceTempView("games")
    user_ids(spark, sf_dir).createOrReplaceTempView("user_ids")
