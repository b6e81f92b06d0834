"""The corpus pipeline, stage by stage, on planted documents; queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from elotrail.llm.oracle import ORACLE
from elotrail.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(ORACLE[name]).to_arrow_table().to_pylist()
    got = QUERIES[name](spark, SF)
    assert set(got.columns) == set(want[0])
    row = lambda r: str([round(r[c], 6) if isinstance(r[c], float) else r[c] for c in sorted(got.columns)])
    assert sorted(row(r.asDict()) for r in got.collect()) == sorted(map(row, want))


def test_registered():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    clean = docs.filter("doc_id = 0").first()
    planted = spark.createDataFrame(
        [(10_000, f"{clean['text']}\n{benchmark}", "en", "src0", 1), (10_001, clean["text"], "en", "src1", 1),
         (10_002, None, None, None, None), (10_003, "", "en", "src2", 0)], docs.schema)
    now = docs.union(planted)
    rows = {}
    for c in ("score", "predicted", "n_hit", "items", "fp", "size", "copies"):  # clashing names
        now = now.withColumn(c, F.lit("own"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.dtypes == now.dtypes
        now = spark.createDataFrame(out.collect(), now.schema)
        assert {r["score"] + r["n_hit"] for r in now.select("score", "n_hit").collect()} == {"ownown"}
        rows[name] = [r["doc_id"] for r in now.select("doc_id").collect()]
    assert 10_001 in rows["quality classifier"]
    near = rows["SimHash near-dedup"]
    assert len(near) == len(set(near)) and 0 in near and 10_001 not in near and 10_000 in near
    assert 10_000 not in rows["benchmark decontamination"] and 0 in rows["benchmark decontamination"]
    mixed = rows["mixing sources to target weights"]
    assert max(map(mixed.count, mixed)) <= 3 and set(mixed) <= set(rows["benchmark decontamination"])
    files = corpus_pipeline.token_files(spark, now, SF).collect()
    assert sorted(r["doc_id"] for r in files) == sorted(mixed)
    starts = sorted((r["start"], r["n_tokens"]) for r in files)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
