"""Hand-written PGN edge cases (FIXTURES §3) through the full ingest."""

import bz2

import pytest
from pyspark.sql import functions as F

from elotrail.plans.ingest import ingest, load_games, load_users
from elotrail.sources.pgn import parse_tags, read_pgn

BASE = {"Event": "Rated Blitz game", "White": "alice", "Black": "bob", "Result": "1-0",
        "UTCDate": "2013.01.01", "UTCTime": "00:00:05", "WhiteElo": "1500",
        "BlackElo": "1480", "WhiteRatingDiff": "+5", "BlackRatingDiff": "-6", "ECO": "C20",
        "Opening": "Vienna", "TimeControl": "300+5", "Termination": "Normal"}


def rec(site, moves="1. e4 e5 1-0", drop=(), **tags):
    t = dict(BASE, Site=f"https://example.org/{site}")
    t.update(tags)
    lines = [f'[{k} "{v}"]' for k, v in t.items() if k not in drop]
    return "\n".join(lines) + "\n\n" + moves + "\n\n"


FILE1 = "".join([
    rec("g0001", moves="1. e4 { [%eval 0.1] } e5 1-0"),
    rec("g0016", White="x" * 31),
    rec("g0002", WhiteElo="?", White="carol"),
    rec("g0003", BlackElo="1500?"),
    rec("g0004", drop=("WhiteRatingDiff",)),
    rec("g0005", WhiteTitle="GM", BlackTitle="BOT", TimeControl="-"),
    rec("g0006", TimeControl="600", Event="Rated UltraBullet game"),
    rec("g0007", Event="Rated Standard game", Termination="Rules infraction", Result="*"),
    rec("g0008", Event="Casual Chess960 game", Round="1", Date="2013.01.01", Foo="bar"),
    rec("g0009", moves="0-1", WhiteTitle="IM", White="dave"),
    rec("g0010"),
    rec("g0011", moves="1-0"),
    rec("g0012", moves="1/2-1/2", Result="1/2-1/2"),
    rec("g0013", drop=("ECO",)),
    rec("g0014", drop=("UTCDate",)),
    rec("g0001", moves="1. d4 0-1", Result="0-1"),
    rec("g0017", drop=("Black",)),
])
FILE2 = rec("g0001", Result="0-1") + rec("g0015", White="erin")


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pgn")
    for name, text in (("db_2013-01.pgn.bz2", FILE1), ("db_2013-02.pgn.bz2", FILE2)):
        (d / name).write_bytes(bz2.compress(text.encode()))
    root = str(tmp_path_factory.mktemp("tables"))
    stats = ingest(spark, [str(d / "db_2013-01.pgn.bz2")], root)
    stats2 = ingest(spark, [str(d / "db_2013-02.pgn.bz2")], root)
    games = {r["site"]: r.asDict() for r in load_games(spark, root).collect()}
    users = {r["username"]: r["id"] for r in load_users(spark, root).collect()}
    return stats, stats2, games, users, root, d


def test_rating_rules(loaded):
    _, _, g, _, _, _ = loaded
    for site in ("g0002", "g0003", "g0004"):
        assert site not in g
    assert g["g0001"]["whiteratingdiff"] == 5 and g["g0001"]["blackratingdiff"] == -6


def test_users_of_dropped_games_get_ids(loaded):
    _, _, _, users, _, _ = loaded
    assert users["alice"] == 1 and users["bob"] == 2 and users["carol"] == 3
    assert "dave" in users and users["erin"] == max(users.values())
    assert sorted(users.values()) == list(range(1, len(users) + 1))


def test_codes_and_defaults(loaded):
    _, _, g, _, _, _ = loaded
    assert g["g0001"]["analyzed"] is True and g["g0010"]["analyzed"] is False
    assert g["g0010"]["whitetitle"] is None and g["g0010"]["blacktitle"] is None
    assert (g["g0005"]["whitetitle"], g["g0005"]["blacktitle"]) == ("GM", "BOT")
    assert g["g0005"]["timecontrol"] == 0 and g["g0006"]["timecontrol"] == 0
    assert g["g0010"]["timecontrol"] == 300 + 5 * 40
    assert g["g0006"]["event"] == "b" and g["g0007"]["event"] == "R"
    assert g["g0008"]["event"] == "?"
    assert g["g0007"]["termination"] == "?" and g["g0007"]["result"] == "?"
    assert g["g0010"]["termination"] == "N" and g["g0010"]["result"] == "W"


def test_moveless_records(loaded):
    _, _, g, _, _, _ = loaded
    assert "g0009" not in g
    assert g["g0010"]["whitetitle"] is None  # no tag leaks from the '0-1' record
    assert g["g0011"]["analyzed"] is False and g["g0012"]["result"] == "D"


def test_first_copy_wins(loaded):
    _, _, g, _, _, _ = loaded
    assert g["g0001"]["result"] == "W" and g["g0001"]["analyzed"] is True


def test_rejects_have_reasons(spark, loaded):
    _, _, g, _, root, _ = loaded
    assert "g0013" not in g and "g0014" not in g
    rej = {r["site"]: r["reason"] for r in spark.read.parquet(f"{root}/rejects").collect()}
    assert rej["g0013"] == "eco is null" and rej["g0014"] == "date_time is null"
    # no id for a name longer than the dimension allows, or for a missing tag
    assert rej["g0009"] == "no movetext"
    assert rej["g0016"] == "white is null" and rej["g0017"] == "black is null"


def test_small_last_file_fully_written(loaded):
    stats, stats2, g, _, _, _ = loaded
    assert "g0015" in g and stats2["games_added"] == 1


def test_rerun_changes_nothing(spark, loaded):
    _, _, g, users, root, d = loaded
    n_rej = spark.read.parquet(f"{root}/rejects").count()
    again = ingest(spark, [str(d / "db_2013-01.pgn.bz2"), str(d / "db_2013-02.pgn.bz2")], root)
    assert again == {"users_added": 0, "games_added": 0}
    assert load_games(spark, root).count() == len(g)
    assert load_games(spark, root).select(F.countDistinct("site")).first()[0] == len(g)
    assert spark.read.parquet(f"{root}/rejects").count() == n_rej == 5


def load_text(spark, tmp_path, text, root=None, name="a.pgn.bz2"):
    (tmp_path / name).write_bytes(bz2.compress(text.encode()))
    root = root or str(tmp_path / "tables")
    ingest(spark, str(tmp_path / name), root)
    return root


def test_record_layouts(spark, tmp_path):
    """A note line, a second blank line and moves right after the tags close a record; the
    last of a repeated tag counts."""
    plain = rec("h0004")
    text = (rec("h0001", moves=" { a note }\n1. e4 1-0") + rec("h0002", moves="\n1. e4 1-0")
            + rec("h0003").replace("\n\n1. e4", "\n1. e4")
            + plain.replace('[WhiteElo "1500"]', '[WhiteElo "1500"]\n[WhiteElo "1600"]')
            + rec("h0005", moves="{ only a note }"))
    root = load_text(spark, tmp_path, text)
    elo = {r["site"]: r["whiteelo"] for r in load_games(spark, root).collect()}
    assert elo == {"h0001": 1500, "h0002": 1500, "h0003": 1500, "h0004": 1600}
    rej = spark.read.parquet(f"{root}/rejects").collect()
    assert [(r["site"], r["reason"]) for r in rej] == [("h0005", "no movetext")]


def lines(site, *more, moves="1. e4 e5 1-0", **tags):
    """A record without the blank lines; ``more``: lines put first."""
    text = rec(site, moves=moves, **tags).replace("\n\n", "\n").rstrip("\n")
    own = [x for x in text.split("\n") if not any(x.split(" ")[0] == m.split(" ")[0] for m in more)]
    return "\n".join([*more, *own]) + "\n"


def spaced(i):
    """The i-th of a row of games in ever other layouts."""
    site = f"{i:08d}"
    text = [lines(site), lines(site) + " \n", rec(site).replace("\n", "\r\n"), lines(site, f'[Site "https://example.org/{site}"]'),
            lines(site, '[White "zoe"]', '[Black "yan"]'), rec(site), rec(site) + "\n\n",
            lines(site, f'[Site "https://example.org/{site}"]').replace("\n", "\r\n")]
    return text[i % len(text)]


LAYOUTS = {"no blank line": lines("a1") + lines("a2") + lines("a3"),
           "a space": " \n".join(lines(f"a{i}") for i in (1, 2, 3)),
           "crlf": "".join(rec(f"a{i}") for i in (1, 2, 3)).replace("\n", "\r\n"),
           "crlf, no blank line": "".join(lines(f"a{i}") for i in (1, 2, 3)).replace("\n", "\r\n"),
           "site first": "".join(lines(f"a{i}", f'[Site "https://example.org/a{i}"]') for i in (1, 2, 3)),
           "site first, blank lines": "\n\n".join(lines(f"a{i}", f'[Site "https://example.org/a{i}"]') for i in (1, 2, 3)),
           "no event": rec("a1", drop=("Event",)) + rec("a2", drop=("Event",)) + rec("a3"),
           "byte order mark": "\ufeff" + rec("a1") + rec("a2") + rec("a3"),
           "moves over several lines": "".join(rec(f"a{i}", moves="1. e4 e5\n12. d4 d5\n1-0") for i in (1, 2, 3))}


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_games_of_any_layout(spark, tmp_path, layout):
    root = load_text(spark, tmp_path, LAYOUTS[layout])
    got = {r["site"]: r for r in load_games(spark, root).collect()}
    assert sorted(got) == ["a1", "a2", "a3"]
    event = {r["event"] for r in got.values()}
    assert event == ({"B", "?"} if layout == "no event" else {"B"})


def test_open_tags_join_the_game_below(spark, tmp_path):
    """They overrule nothing below them, do not leak into the game before, and stay on
    record where no game follows."""
    text = (lines("b1", '[WhiteElo "1900"]', '[Site "https://example.org/b1"]').replace(
                "[WhiteRatingDiff", '[WhiteElo "1650"]\n[WhiteRatingDiff')
            + lines("b2", '[Site "https://example.org/b2"]', moves="0-1") + lines("b3", '[WhiteTitle "IM"]')
            + '[Site "https://example.org/b4"]\n[WhiteElo "1500"]\n')
    root = load_text(spark, tmp_path, text)
    got = {r["site"]: (r["whiteelo"], r["whitetitle"]) for r in load_games(spark, root).collect()}
    assert got == {"b1": (1650, None), "b3": (1500, "IM")}
    rejects = {r["site"]: r["reason"] for r in spark.read.parquet(f"{root}/rejects").collect()}
    assert rejects == {"b2": "no movetext", "b4": "no movetext"}


@pytest.mark.parametrize("split", [100_000, 450_000, 10_000_000])
def test_any_layout_across_splits(spark, tmp_path, split):
    """bz2 blocks end anywhere, between a game's tags too: every game comes once, with all its
    tags, in batch and as a stream."""
    import random

    from elotrail.sources.pgn import join_open
    from elotrail.operators.stage import cut
    from elotrail.streaming.stream import start_upsert
    rng = random.Random(2)
    n = 6000
    moves = lambda: "1. " + " ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(100))
    text = "".join(spaced(i).replace("1. e4 e5", moves()) for i in range(n))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/big.pgn.bz2").write_bytes(bz2.compress(text.encode(), 1))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        tags = join_open(cut(parse_tags(read_pgn(spark, str(tmp_path / "in")))))
        assert tags.select("Site").distinct().count() == tags.count() == n
        assert tags.filter("Event IS NULL OR moves IS NULL OR WhiteElo IS NULL OR White IS NULL").count() == 0
        assert tags.filter("White = 'zoe'").count() == tags.filter("Black = 'yan'").count() == n // 8
        if split == 100_000:
            start_upsert(spark, str(tmp_path / "in"), str(tmp_path / "db"), str(tmp_path / "ck")).awaitTermination()
            assert load_games(spark, str(tmp_path / "db")).select("site").distinct().count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_an_id_comes_in_once_whatever_its_month(spark, tmp_path):
    root = load_text(spark, tmp_path, rec("m0001", UTCDate="2013.01.31"))
    load_text(spark, tmp_path, rec("m0001", UTCDate="2013.02.01") + rec("m0002"), root, "b.pgn.bz2")
    assert sorted(r["site"] for r in load_games(spark, root).collect()) == ["m0001", "m0002"]


def test_timestamps_do_not_follow_the_session_zone(spark, tmp_path):
    text = rec("z0001", UTCDate="2018.03.11", UTCTime="02:30:00") + rec(
        "z0002", UTCDate="2018.01.31", UTCTime="23:59:59")
    seen = {}
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            root = load_text(spark, tmp_path, text, str(tmp_path / zone.replace("/", "-")))
            seen[zone] = sorted((r["site"], str(r["date_time"]), r["event_month"])
                                for r in load_games(spark, root).collect())
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert seen["UTC"] == seen["America/New_York"] == [
        ("z0001", "2018-03-11 02:30:00", "2018-03"), ("z0002", "2018-01-31 23:59:59", "2018-01")]


def test_a_load_leaves_no_tables_behind(spark, tmp_path):
    from pathlib import Path
    base = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).parent
    cuts = ("tags", "new-users", "checked", "unknown", "split-ranks", "rank-slices", "new-rows", "rejects", "files")
    count = lambda: sum(1 for c in cuts for _ in base.rglob(f"{c}-*"))
    before = count()
    root = load_text(spark, tmp_path, rec("s0001") + rec("s0002"))
    written = lambda: sorted(p.name for p in (tmp_path / "tables").rglob("part-*")
                             if p.parent.name != "loaded_files")
    files = written()
    load_text(spark, tmp_path, rec("s0001"), root, "b.pgn.bz2")
    assert count() == before
    # and a load without news writes no file, but for the ledger's
    assert written() == files
    assert sum(1 for _ in (tmp_path / "tables/loaded_files").glob("part-*")) == 3


def stored_files(root, month="2013-01"):
    from pathlib import Path
    return len(list(Path(root, f"games/event_month={month}").glob("*.parquet")))


def test_a_month_has_the_files_its_bytes_fill(spark, tmp_path):
    """A large month is written by several tasks; small ones give one file each, but for those
    whose hash falls into the large one's of the four shuffle partitions."""
    import random
    rng = random.Random(3)
    small_tasks = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
                   "spark.sql.adaptive.coalescePartitions.enabled": "false",  # several tasks write the cuts
                   "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "64k"}
    old = {k: spark.conf.get(k) for k in small_tasks}
    big = "".join(rec(f"f{i:07d}") for i in rng.sample(range(10**7), 12000))
    small = "".join(rec(f"s{i:03d}", UTCDate=f"2013.{2 + i % 6:02d}.01") for i in range(60))
    for k, v in small_tasks.items():
        spark.conf.set(k, v)
    try:
        root = load_text(spark, tmp_path, big + small)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert stored_files(root) > 1
    assert [stored_files(root, f"2013-{m:02d}") for m in range(2, 8)].count(1) >= 3
    other = load_text(spark, tmp_path, big + small, str(tmp_path / "other"))
    assert stored_files(other) == 1


def test_compaction(spark, tmp_path, monkeypatch):
    from elotrail.plans import ingest as I
    root = None
    for k in range(5):
        text = "".join(rec(f"c{k}{i:03d}") for i in range(40)) + (rec("d0001", UTCDate="2013.02.01") if not k else "")
        root = load_text(spark, tmp_path, text, root, f"{k}.pgn.bz2")
    want = sorted(map(str, load_games(spark, root).collect()))
    assert (stored_files(root), stored_files(root, "2013-02")) == (5, 1)
    assert {r[0]: r["files"] for r in I.file_sizes(spark, root).collect() if r[0]} == {"2013-01": 5, "2013-02": 1}
    # interrupted before the copy is in place: the next load goes on from it
    monkeypatch.setattr(I, "finish_compaction", lambda *a: None)
    assert I.compact(spark, root) == ["2013-01"]
    monkeypatch.undo()
    assert stored_files(root) == 5
    load_text(spark, tmp_path, rec("c0001"), root, "0.pgn.bz2")
    assert (stored_files(root), stored_files(root, "2013-02")) == (1, 1)
    assert sorted(map(str, load_games(spark, root).collect())) == want
    assert I.compact(spark, root) == [] and not (tmp_path / "tables/compaction").exists()
    # a copy that was not written to its end is left out
    (tmp_path / "tables/compaction/event_month=2013-01").mkdir(parents=True)
    I.init_tables(spark, root)
    assert sorted(map(str, load_games(spark, root).collect())) == want


def test_a_reload_reads_its_own_months_only(spark, tmp_path):
    """The stored files of another month are spoilt: a load without news does not open them."""
    text = "".join(rec(f"r{i:03d}") for i in range(30))
    root = load_text(spark, tmp_path, text)
    load_text(spark, tmp_path, "".join(rec(f"q{i:03d}", UTCDate="2015.05.05") for i in range(30)), root, "b.pgn.bz2")
    for f in (tmp_path / "tables/games/event_month=2015-05").iterdir():
        f.write_bytes(b"spoilt")
    assert ingest(spark, str(tmp_path / "a.pgn.bz2"), root) == {"users_added": 0, "games_added": 0}
    with pytest.raises(Exception):  # news have to be compared with all ids
        load_text(spark, tmp_path, rec("n0001"), root, "c.pgn.bz2")


def test_ledger(spark, tmp_path, monkeypatch):
    """Loaded dumps are skipped, one whose load crashed is not."""
    from elotrail.plans import ingest as I
    from elotrail.sources.manifest import read_manifest
    names = [f"db_standard_rated_2013-0{m}.pgn.bz2" for m in (1, 2, 3)]
    (tmp_path / "list.txt").write_text("".join(f"https://example.org/{n}\n" for n in reversed(names)))
    for m, n in enumerate(names[:2], 1):
        (tmp_path / n).write_bytes(bz2.compress(rec(f"l{m}", UTCDate=f"2013.0{m}.02").encode()))
    (tmp_path / names[2]).write_bytes(bz2.compress(b"\n"))
    manifest, root = read_manifest(spark, str(tmp_path / "list.txt")), str(tmp_path / "db")
    run = lambda: I.ingest_pending(spark, manifest, str(tmp_path), root)
    append = I._append

    def crash(df, path, *partitions):
        if path.endswith("/games") and df.filter("site = 'l2'").count():
            raise OSError("no space left")
        return append(df, path, *partitions)

    monkeypatch.setattr(I, "_append", crash)
    with pytest.raises(OSError):
        run()
    assert [r[0] for r in I.loaded_files(spark, root).collect()] == names[:1]
    monkeypatch.undo()
    assert run() == names[1:] and run() == []
    assert sorted(r["site"] for r in load_games(spark, root).collect()) == ["l1", "l2"]
    ingest(spark, str(tmp_path / names[0]), root)
    assert sorted(r[0] for r in spark.read.parquet(f"{root}/loaded_files").collect()) == names


@pytest.mark.parametrize("split", [200_000, 700_000, 10_000_000])
def test_splits_of_a_compressed_dump(spark, tmp_path, split):
    """More than five bz2 blocks: every record comes once, wherever the splits fall."""
    import random
    rng = random.Random(1)
    moves = lambda: "1. " + " ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(120))
    text = "".join(rec(f"{i:08d}", moves=moves() + " 1-0") for i in range(9000))
    path = tmp_path / "big.pgn.bz2"
    path.write_bytes(bz2.compress(text.encode()))
    assert len(text) > 5 * 900_000
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        tags = parse_tags(read_pgn(spark, str(path)))
        r = tags.agg(F.count(F.lit(1)), F.countDistinct("Site"), F.count("ECO"), F.count("moves")).first()
        assert tuple(r) == (9000,) * 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from elotrail.session import ensure_checkpoint_dir
    none = SimpleNamespace(get=lambda k, d=None: d)
    sc = SimpleNamespace(master="spark://host:7077", getConf=lambda: none, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc))
