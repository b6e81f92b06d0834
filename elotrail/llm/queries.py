"""Registered queries of the operators, each over its whole table.

Every callable takes (spark, sf_dir) and derives the contract's columns from its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import table
from .decontaminate import find_benchmark
from .filter_audit import audit_documents
from .licenses import scan_licenses
from .mixing import mix
from .quality import classify, held_out
from .runs import periodic_runs
from .sharding import shard_documents
from .simhash import near_duplicates
from .sketch import fingerprint_documents
from .token_counts import token_counts
from .token_files import document_digests, read_token_files, write_token_files
from .url_filter import judge_urls
from .vector_graph import near_vectors

#: host, path and verdict of the url rules
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"),
             ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file, which is installed on driver and executors."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"),
                        tokenizer_path()).drop("text")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"),
                        F.array_join("licenses", ",").alias("licenses"),
                        F.size("matches").cast("long").alias("n_matches"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return document_digests(read_token_files(spark, path))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"),
                           table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``documents``, in a tenth of them (h = crc32 of the id, h % 10 = 0) with
    the words from a = g % n on repeating a period of 1 + (n - a) div (3 + g % 8) words, g = h div 10."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[ \t-\r]+"), "")
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    d = (docs.select("doc_id", "text", F.when(h % 10 == 0, g).alias("g"))
         .withColumn("n", F.when(F.col("g").isNotNull(), F.size(words))))
    a = (F.col("g") % F.col("n")).cast("int")
    rest = F.col("n") - a
    p = 1 + F.floor(rest / (3 + F.col("g") % 8)).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil(rest / p).cast("int")))
    text = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), rest)), " ")
    return d.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")),
        F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length DIV -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_license_scans, op3_quality_classifier, op4_url_filters, op5_sharding,
    op6_document_fingerprints, op7_simhash_near_dedup, op8_token_files, op9_mixing,
    op10_benchmark_decontamination, op11_embedding_near_dedup, op12_filter_audit,
    op13_periodic_runs, pipeline)}
