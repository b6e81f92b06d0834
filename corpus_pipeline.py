"""The corpus pipeline: quality, near copies, benchmark passages, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's documents; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elotrail.llm.common import table, text_of
from elotrail.llm.decontaminate import find_benchmark
from elotrail.llm.mixing import mix
from elotrail.llm.quality import classify
from elotrail.llm.queries import tokenizer_path
from elotrail.llm.simhash import keep_one
from elotrail.llm.token_files import document_digests, read_token_files, write_token_files
from elotrail.session import scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scored = classify(docs, table(spark, sf_dir, "labels"), prefix="__")
    return scored.filter("__predicted = 1").select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark"), prefix="__")
    return found.filter("__n_hit = 0").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 3 times), in no particular order.

    The mix is worked out on narrow rows and joined back to the texts; rows that repeat a
    document are one there, with the sum of their copies."""
    h = F.xxhash64(text_of())
    mixed = mix(docs.select("doc_id", "text", "source", h.alias("__h")), keep=("__h",))
    taken = (mixed.groupBy(F.col("doc_id").alias("__d"), F.col("source").alias("__s"),
                           F.col("kept_0").alias("__k"))
             .agg(F.sum("copies").cast("int").alias("__n")).filter("__n > 0"))
    return (docs.withColumn("__h", h)
            .join(taken, F.col("doc_id").eqNullSafe(F.col("__d"))
                  & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__h") == F.col("__k")))
            .dropDuplicates(["doc_id", "source", "__h"])
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
            .select(*docs.columns))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of the mix, and a row for each document in them: doc_id, start,
    n_tokens and ids_crc32, as read back from the files."""
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path())
    return document_digests(read_token_files(spark, path))


STAGES = [("quality classifier", quality_classifier),
          ("SimHash near-dedup", simhash_near_dedup),
          ("benchmark decontamination", benchmark_decontamination),
          ("mixing sources to target weights", mixing),
          ("token-ID / binary output", token_files)]

#: the classifier, XXH64 and the tokenizer are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{k + 1}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
