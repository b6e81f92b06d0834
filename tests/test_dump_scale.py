"""What lets the dump and its readers scale: short generated methods, files and lines dealt to all cores."""

import re

import pytest

from elotrail.plans import loads as L
from elotrail.session import scratch_path
from elotrail.sources import fixtures as X
from elotrail.sources.pgn import parse_tags, read_pgn
from elotrail.sources.tables import games, user_ids
from elotrail.streaming import stream as S



SF_SMALL = "/root/testdata/sf0.001"
LONGEST = 8000  # bytes; the JVM compiles no longer method


@pytest.fixture(scope="module")
def tables(spark):
    return games(spark, SF_SMALL), user_ids(spark, SF_SMALL)


def longest_method(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text)))


def test_scan_is_compiled(spark, tables):
    tags = parse_tags(read_pgn(spark, L.dump_of(*tables)))
    assert longest_method(L.games_from_tags(tags, tables[1])[0]) < LONGEST


@pytest.mark.parametrize("records", [X.render_records, X.dirty_records])
def test_rendering_is_compiled(spark, tables, records):
    dealt = X._deal(X.with_names(*tables), 8, "site", "site")
    assert longest_method(records(X.tags_of(dealt)).select("value")) < LONGEST


def test_dealt_games_give_the_same_dump(spark, tables):
    """Records made after the games were dealt are those that are dealt as text."""
    for records in (X.render_records, X.dirty_records):
        old = X.write_dump(records(X.render_tags(*tables)), files=3)
        new = X.dump_games(*tables, records, files=3)
        text = lambda path: "".join(r[0] for r in spark.read.text(path, wholetext=True).sort("_metadata.file_path").collect())
        assert sorted(text(old).split("\n")) == sorted(text(new).split("\n"))


@pytest.mark.parametrize("n, text", [(5, "+5"), (-6, "-6"), (0, "+0"), (None, "null")])
def test_signed(spark, n, text):
    df = spark.createDataFrame([(n,)], "n int")
    assert df.select(X._signed(df.n)).first()[0] == text


@pytest.mark.parametrize("key", ["stream_parse", "stream_dedup", "stream_upsert"])
def test_a_micro_batch_feeds_all_cores(spark, tables, monkeypatch, key):
    seen = []
    record_stream = S.record_stream

    def seeing(spark, landing, max_files=1):
        seen.append((max_files, spark.read.format("binaryFile").load(landing).count()))
        return record_stream(spark, landing, max_files)

    monkeypatch.setattr(S, "record_stream", seeing)
    got = getattr(L, key)(spark, *tables)
    cores = spark.sparkContext.defaultParallelism
    for max_files, files in seen:
        assert files >= cores and 2 * max_files >= cores and files <= 8 * max_files
    assert got.count() == tables[0].count()


def test_log_in_segments_side_by_side(spark, tables, tmp_path, monkeypatch):
    """A key's lines come in several files, in order; a trigger takes in several keys."""
    monkeypatch.setattr(S, "SEGMENT_LINES", 50)
    body = '[Event "e"]\r\n[Site "https://example.org/{0}"]\n \n\n1. e4 1-0\n\n'
    for name in "abc":
        (tmp_path / f"{name}.pgn").write_text("".join(body.format(f"{name}{i:03d}") for i in range(40)))
    (tmp_path / "d.pgn").write_text('"no tag"\n' + body.format("d000"))
    log = S.replay_lines(spark, str(tmp_path), scratch_path(spark, "log"))
    rows = spark.read.parquet(log).sort("key", "offset").collect()
    for name in "abcd":
        want = [x for x in (tmp_path / f"{name}.pgn").read_text().splitlines() if x.strip(" ")]
        assert [r["value"] for r in rows if r["key"] == f"{name}.pgn"] == want
    files = spark.read.parquet(log).selectExpr("_metadata.file_path f").groupBy("f").count().collect()
    assert len(files) >= 6 and max(r["count"] for r in files) <= 50
    out = scratch_path(spark, "out")
    S.run_to_table(S.assemble(S.line_stream(spark, log, max_files=3)), out, scratch_path(spark, "ck"))
    sites = sorted(r[0] for r in spark.read.parquet(out).selectExpr("regexp_extract(raw, 'org/(\\\\w+)', 1)").collect())
    assert sites == sorted(f"{n}{i:03d}" for n in "abc" for i in range(40)) + ["d000"]


@pytest.mark.parametrize("line, value", [('[A "x"]', "x"), ('[A "a"b"]', 'a"b'), ('[A "a"] "]', "a"), ('[A ""]', ""),
                                         ('[A """]', '"'), ('[A "x" ]', None), ('[A "x', None)])
def test_value_of_a_tag_line(spark, line, value):
    from pyspark.sql import functions as F
    from elotrail.sources.pgn import TAG_LINE
    df = spark.createDataFrame([(f'[B "b"]\n{line}\n[C "c"]',)], "t string")
    got = df.select(F.regexp_extract_all("t", F.lit(TAG_LINE), F.lit(2))).first()[0]
    assert got == (["b", "c"] if value is None else ["b", value, "c"])
