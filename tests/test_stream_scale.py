"""What lets the streams scale: lines packed before the shuffle, short generated methods, few state
partitions, micro-batches that fill the cores, one look at narrow rows in the load."""

import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from elotrail.plans import loads as L
from elotrail.plans.ingest import games_from_tags
from elotrail.session import settings
from elotrail.sources.pgn import parse_tags
from elotrail.sources.tables import games, user_ids
from elotrail.streaming import stream as S
from tests.test_dump_scale import LONGEST, longest_method

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return games(spark, SF_SMALL), user_ids(spark, SF_SMALL)


class State:
    def __init__(self):
        self.get = None

    exists = property(lambda self: self.get is not None)

    def update(self, value):
        self.get = value

    def remove(self):
        self.get = None


def plain(lines):
    """(offset, record) of the messages of one key, line by line."""
    kept, first = [], None
    for offset, line in lines:
        if line.startswith("[Event "):
            kept, first = [line], offset
        elif line.startswith("[") and kept:
            kept.append(line)
        elif kept and line.startswith("1"):
            yield first, "\n".join(kept) + "\n\n" + line
            kept = []


@pytest.mark.parametrize("seed", range(30))
def test_packed_lines_give_the_records_of_single_lines(seed, monkeypatch):
    """Batches of several keys, also none, whose offsets interleave; games cut by micro-batches."""
    rnd = random.Random(seed)
    monkeypatch.setattr(S, "STEP_LINES", rnd.choice((1, 7, 1000)))
    kinds = ['[Event "e{}"]', '[Site "s{}"]', '[Eventful "{}"]', "1. e4 {}", "{{ note {} }}", "0-1", "[", "1", "ä {}"]
    log = {k: [(3 * i, rnd.choice(kinds).format(i)) for i in range(rnd.randint(0, 120))] for k in ("a", None, "b")}
    found, states = {k: [] for k in log}, {k: State() for k in log}
    cuts = sorted(rnd.sample(range(360), 2))
    for low, high in zip([0, *cuts], [*cuts, 360]):
        rows = [(k, o, x) for k, lines in log.items() for o, x in lines if low <= o < high]
        rnd.shuffle(rows)
        if rnd.random() < 0.5:
            rows.sort(key=lambda r: r[1])
        batches = [pa.RecordBatch.from_pandas(pd.DataFrame(rows[i:i + 40], columns=["key", "offset", "value"]),
                   pa.schema({"key": pa.string(), "offset": pa.int64(), "value": pa.string()}), preserve_index=False)
                   for i in range(0, len(rows), 40)]
        packed = [p for b in batches for p in S._pack([b])]
        assert len(packed) <= 3 * len(batches)
        for key in log:
            mine = [p.to_pandas() for p in packed if p.column("key")[0].as_py() == key]
            if mine:
                for pdf in S._assemble_group((key,), iter(mine), states[key]):
                    found[key] += zip(pdf["offset"], pdf["raw"])
    assert found == {k: list(plain(lines)) for k, lines in log.items()}


def test_lines_are_packed_before_the_shuffle(spark, tables):
    log = S.replay_lines(spark, L.dump_of(*tables), L.scratch_path(spark, "log"))
    lines = spark.read.schema(S.LINE_SCHEMA).parquet(log)
    packed = lines.select("key", "offset", "value").mapInArrow(S._pack, S.PACKED)
    assert 100 * packed.count() < lines.count()
    streamed = S.assemble(S.line_stream(spark, log))._jdf.queryExecution().logical().toString()
    assert streamed.index("FlatMapGroupsInPandasWithState") < streamed.index("MapInArrow")


def test_assembled_games_are_compiled(spark, tables):
    recs = spark.createDataFrame([], S.ASSEMBLED)
    tags = parse_tags(recs.select(F.col("key").alias("file"), F.lit(0).cast("long").alias("block"),
                                  F.col("offset").alias("pos"), "raw"))
    assert longest_method(games_from_tags(tags, tables[1])[0]) < LONGEST


def test_state_partitions_follow_the_keys(spark, tables, monkeypatch):
    seen, run = [], S.run_to_table
    monkeypatch.setattr(S, "run_to_table", lambda *a: (seen.append(spark.conf.get("spark.sql.shuffle.partitions")), run(*a)))
    with settings(spark, {"spark.sql.shuffle.partitions": "50"}):
        got = L.stream_assemble(spark, *tables)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
    assert seen == [str(L.dump_files(spark))]
    assert got.exceptAll(tables[0]).isEmpty() and got.count() == tables[0].count()


@pytest.mark.parametrize("raw", ['[Event "x"]\n[A "b"]\n\n1. e4 1-0\r\n', '[Event "x"]\n\n0-1', '[A "b"]\n1', "[A \"b\"]\n12\n1. x\n[B \"c\"]",
                                 "\n1. e4", "1. e4\n\n1. d4\n2. x", "", '[A "b"]\n\n1. e4 ä\r\r\n\n1. e5'])
def test_head_and_movetext(spark, raw):
    """Parted at the first line after another that starts with 1."""
    from elotrail.sources.pgn import at_movetext, movetext
    r = spark.createDataFrame([(raw,)], "raw string").select(at_movetext(F.col("raw")).alias("p")).select(
        F.col("p")[0].alias("head"), movetext(F.get("p", F.lit(1))).alias("moves")).first()
    head, sep, rest = raw.partition("\n1")
    assert r["head"] == head and r["moves"] == ("1" + rest.split("\n")[0].rstrip("\r") if sep else None)


class Stop(Exception):
    pass


def test_a_quarter_of_the_files_fills_all_cores(spark, tables, monkeypatch):
    """One file a core and more in each of the load's micro-batches."""
    def start(spark, landing, root, checkpoint, max_files):
        cores, files = spark.sparkContext.defaultParallelism, spark.read.format("binaryFile").load(landing).count()
        raise Stop(max_files >= cores and files == 4 * max_files)

    monkeypatch.setattr(S, "start_upsert", start)
    with pytest.raises(Stop) as stopped:
        L.stream_upsert(spark, *tables)
    assert stopped.value.args == (True,)


def test_both_deliveries_are_read_whole(spark, tables, monkeypatch):
    """One dump, delivered twice, a quarter of it a micro-batch; state off the heap, in partitions by cores."""
    rows, files, rendered, held = [], [], [], []
    game_stream, dump_games = S.game_stream, L.dump_games

    def seeing(spark, landing, max_files=1):
        files.append((max_files, spark.read.format("binaryFile").load(landing).count()))
        return game_stream(spark, landing, max_files)

    def run(stream, out, checkpoint):
        held.append([spark.conf.get(k) for k in (L.STATE_STORE, L.PARTITIONS)])
        q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
        rows.append([p["numInputRows"] for p in q.recentProgress if p["numInputRows"]])

    monkeypatch.setattr(S, "run_to_table", run)
    monkeypatch.setattr(S, "game_stream", seeing)
    monkeypatch.setattr(L, "dump_games", lambda *a, **k: (rendered.append(a), dump_games(*a, **k))[1])
    hdfs, cores = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider", spark.sparkContext.defaultParallelism
    with settings(spark, {L.PARTITIONS: "50", L.STATE_STORE: hdfs}):
        got = L.stream_dedup(spark, *tables)
        assert spark.conf.get(L.PARTITIONS) == "50" and spark.conf.get(L.STATE_STORE) == hdfs
    assert len(rendered) == 1 and files == 2 * [(files[0][0], 4 * files[0][0])] and files[0][0] >= cores
    assert [len(r) for r in rows] == [4, 4] and [sum(r) for r in rows] == 2 * [tables[0].count()]
    assert held == 2 * [[L.ROCKSDB, str(L.STATE_PER_CORE * cores)]]
    assert got.exceptAll(tables[0]).isEmpty() and got.count() == tables[0].count()


@pytest.mark.parametrize("seed, order", [(0, ["pos"]), (1, ["part", "pos"])])
def test_keys_are_looked_up_on_narrow_rows(spark, monkeypatch, seed, order):
    """As ``upsert_ignore``, with keys that repeat or are null; what is written before the rows has no more
    than key and order."""
    from elotrail.operators import upsert as U
    rnd, written, cut = random.Random(seed), [], U.cut
    monkeypatch.setattr(U, "cut", lambda df, name: (written.append(df.columns), cut(df, name))[1])
    key = lambda n: rnd.choice([None, *map(str, range(n))])
    new = cut(spark.createDataFrame([(key(60), p, rnd.choice("ab"), f"text {p}") for p in range(100)],
                                    "site string, pos long, part string, text string"), "new")
    for old in ([], [(str(k), rnd.choice("abc")) for k in range(0, 60, 1 + seed)]):
        existing = cut(spark.createDataFrame(old, "site string, part string"), "old")
        want = U.upsert_ignore(new, existing, "site", order).select(new.columns)
        got = U.upsert_ignore_near(new, existing, "site", order, "part")
        assert got.columns == new.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert written and all(set(c) <= {"site", "_first", *order} for c in written)
    again = U.upsert_ignore_near(new.filter("site IS NOT NULL"), new, "site", order, "part")
    assert again.columns == new.columns and again.isEmpty()
