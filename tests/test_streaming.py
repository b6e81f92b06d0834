"""Keyed-state game assembly across micro-batches (T3) and stream dedup (T5)."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from elotrail.session import scratch_path
from elotrail.streaming.stream import (LINE_SCHEMA, assemble, dedup, game_stream, line_stream,
                                       run_to_table)


def _game(i, moves=None, title=False):
    lines = [f'[Event "Rated Blitz game"]', f'[Site "https://example.org/g{i:04d}"]',
             f'[White "w{i}"]', f'[Black "b{i}"]']
    if title:
        lines.append('[WhiteTitle "GM"]')
    return lines + [moves or "1. e4 e5 1-0"]


def test_games_cut_across_micro_batches(spark):
    lines = []
    for i in range(40):
        lines += _game(i, moves="0-1" if i == 7 else None, title=(i == 7))
    msgs = pd.DataFrame({"key": "dump-a", "partition": 0, "offset": range(len(lines)),
                         "value": lines})
    log = scratch_path(spark, "log")
    # five files of 41 lines: most file borders cut a game in two
    for j, start in enumerate(range(0, len(msgs), 41)):
        # one file per chunk, written in order: a topic partition's order
        spark.createDataFrame(msgs.iloc[start:start + 41], LINE_SCHEMA).coalesce(1) \
            .write.mode("append").parquet(f"{log}")
        time.sleep(0.05)
    out = scratch_path(spark, "out")
    run_to_table(assemble(line_stream(spark, log, max_files=1)), out,
                 scratch_path(spark, "ck"))
    got = spark.read.parquet(out)
    sites = sorted(r[0] for r in got.select(
        F.regexp_extract("raw", r"org/(g\d+)", 1)).collect())
    assert sites == sorted(f"g{i:04d}" for i in range(40) if i != 7)
    # the move-less record's title did not leak into the next game
    nxt = got.filter(F.col("raw").contains("g0008")).first()["raw"]
    assert "WhiteTitle" not in nxt


def test_notes_between_tags_and_moves(spark):
    lines = _game(1)[:-1] + [" { note }", "% remark", "1. e4 1-0"] + _game(2)
    log = scratch_path(spark, "log")
    spark.createDataFrame(pd.DataFrame({"key": "k", "partition": 0, "offset": range(len(lines)),
                                        "value": lines}), LINE_SCHEMA).coalesce(1).write.parquet(log)
    out = scratch_path(spark, "out")
    run_to_table(assemble(line_stream(spark, log)), out, scratch_path(spark, "ck"))
    assert spark.read.parquet(out).count() == 2


def test_dedup_keeps_a_backfilled_month(spark, tmp_path):
    """Later months come first, one file a micro-batch; each game comes in two files."""
    text = lambda month: "".join("\n".join(
        _game(month * 100 + i)[:-1]
        + [f'[UTCDate "2013.{month:02d}.03"]', '[UTCTime "00:00:01"]']) + "\n\n1. e4 1-0\n\n"
        for i in range(20))
    for k, month in enumerate((9, 1, 5, 9, 1)):
        (tmp_path / f"{k}.pgn").write_text(text(month))
        time.sleep(0.05)
    out = scratch_path(spark, "out")
    run_to_table(dedup(game_stream(spark, str(tmp_path), max_files=1)), out, scratch_path(spark, "ck"))
    got = [r[0] for r in spark.read.parquet(out).select("site").collect()]
    assert sorted(got) == sorted(f"g{m * 100 + i:04d}" for m in (1, 5, 9) for i in range(20))


def _write_months(folder, months, games=20, start=0):
    """One file a month, in this order of arrival; each game comes in two files."""
    text = lambda month: "".join("\n".join(
        _game(month * 100 + i)[:-1]
        + [f'[UTCDate "2013.{month:02d}.03"]', '[UTCTime "00:00:01"]', '[Result "1-0"]', '[WhiteElo "1500"]',
           '[BlackElo "1500"]', '[WhiteRatingDiff "+1"]', '[BlackRatingDiff "-1"]', '[ECO "A00"]',
           '[TimeControl "60+0"]', '[Termination "Normal"]']) + "\n\n1. e4 1-0\n\n" for i in range(games))
    for k, month in enumerate(months, start):
        (folder / f"{k:02d}.pgn").write_text(text(month))
        time.sleep(0.05)


def test_dedup_state_expires_and_the_load_takes_over(spark, tmp_path):
    """State holds a few micro-batches at most; a game that comes back after that passes and is
    left out by K3, and a backfilled month is whole."""
    from elotrail.operators.upsert import upsert_ignore
    (tmp_path / "in").mkdir()
    _write_months(tmp_path / "in", (9, 9, 10, 11, 12, 1, 2, 9, 5, 5))
    root, states = str(tmp_path / "games"), []

    def sink(batch, epoch):
        from elotrail.session import exists
        stored = batch.sparkSession.read.parquet(root) if exists(root, batch.sparkSession) else None
        new = upsert_ignore(batch.withColumn("pos", F.monotonically_increasing_id()), stored, "site", ["pos"])
        new.drop("pos").write.mode("append").parquet(root)

    stream = dedup(game_stream(spark, str(tmp_path / "in"), max_files=1), keep="1 millisecond")
    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    states = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert len(states) >= 10 and max(states) <= 3 * 20
    got = [r[0] for r in spark.read.parquet(root).select("site").collect()]
    assert sorted(got) == sorted(f"g{m * 100 + i:04d}" for m in (9, 10, 11, 12, 1, 2, 5) for i in range(20))


def test_dedup_keeps_rows_without_an_id(spark, tmp_path):
    (tmp_path / "a.pgn").write_text('[Event "x"]\n[White "a"]\n\n1. e4\n\n[Event "y"]\n[White "b"]\n\n1. d4\n')
    out = scratch_path(spark, "out")
    run_to_table(dedup(game_stream(spark, str(tmp_path))), out, scratch_path(spark, "ck"))
    assert sorted(r[0] for r in spark.read.parquet(out).select("white_name").collect()) == ["a", "b"]


@pytest.mark.parametrize("how", ["between", "within"])
def test_a_stopped_load_goes_on(spark, tmp_path, how, monkeypatch):
    """A load stopped between micro-batches, or failing in the middle of one, goes on from its
    checkpoint with the files added since: nothing is lost or doubled."""
    from elotrail.plans import ingest as I
    from elotrail.streaming.stream import start_upsert
    landing, root, ck = tmp_path / "in", str(tmp_path / "db"), str(tmp_path / "ck")
    landing.mkdir()
    _write_months(landing, (1, 2, 3), games=5)
    if how == "within":
        append = I._append

        def failing(df, path, *partitions):
            if path.endswith("/games") and df.filter("site LIKE 'g02%'").count():
                raise OSError("executor lost")
            return append(df, path, *partitions)

        monkeypatch.setattr(I, "_append", failing)
        q = start_upsert(spark, str(landing), root, ck)
        with pytest.raises(Exception, match="executor lost"):
            q.awaitTermination()
        monkeypatch.undo()
        assert sorted({r[0][:3] for r in I.load_games(spark, root).select("site").collect()}) == ["g01"]
    else:
        q = start_upsert(spark, str(landing), root, ck, available_now=False)
        while not (q.lastProgress or {}).get("batchId", 0) >= 1:
            time.sleep(0.2)
        q.stop()
    _write_months(landing, (4, 2), games=5, start=3)  # a new month, and one once more
    start_upsert(spark, str(landing), root, ck).awaitTermination()
    sites = sorted(r[0] for r in I.load_games(spark, root).select("site").collect())
    assert sites == sorted(f"g{m * 100 + i:04d}" for m in (1, 2, 3, 4) for i in range(5))
    users = I.load_users(spark, root).collect()
    assert sorted(u["id"] for u in users) == list(range(1, len(users) + 1)) and len(users) == 40
    assert len({u["username"] for u in users}) == 40
    assert sorted(r[0] for r in I.loaded_files(spark, root).collect()) == [f"{k:02d}.pgn" for k in range(5)]


def test_assembly_goes_on_from_its_state(spark, tmp_path):
    """T7 for T3: the run ends within a game, whose lines the state keeps for the next run."""
    lines = [x for i in range(6) for x in _game(i)]
    log, out, ck = scratch_path(spark, "log"), scratch_path(spark, "out"), scratch_path(spark, "ck")
    msgs = pd.DataFrame({"key": "k", "partition": 0, "offset": range(len(lines)), "value": lines})
    for cut in (slice(0, 13), slice(13, len(lines))):
        spark.createDataFrame(msgs.iloc[cut], LINE_SCHEMA).coalesce(1).write.mode("append").parquet(log)
        run_to_table(assemble(line_stream(spark, log)), out, ck)
    got = spark.read.parquet(out).select(F.regexp_extract("raw", r"org/(g\d+)", 1)).collect()
    assert sorted(r[0] for r in got) == [f"g{i:04d}" for i in range(6)]
