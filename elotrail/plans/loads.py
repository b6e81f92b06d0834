"""Registered load-path queries over the driver tables: PGN round trip,
dense ids, upserts, manifests, CSV hand-off.  Each derives its input from
``games`` / ``user_ids`` with Spark (written to the shared scratch folder
where a file is needed) and runs the production operator on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.keys import assign_ids, encode_players
from ..operators.players import games_per_player
from ..operators.stage import cut
from ..operators.upsert import upsert_ignore
from ..schema import GAMES_COLUMNS
from ..session import ROCKSDB, STATE_STORE, rename, scratch_path, settings
from ..sources.fixtures import dirty_records, dump_files, dump_games
from ..sources.manifest import manifest_from_games, pending_months, read_manifest, select_months
from ..sources.pgn import TAGS, join_open, parse_tags, read_pgn
from ..sources.results import read_ordered, read_result, write_result
from .ingest import games_from_tags, with_partition
from .queries import games_per_bracket

SPLIT = "1997-01-01 00:00:00"
# Second load of the dimension: early enough that many players are new.
ID_SPLIT = "1995-02-01 00:00:00"


def _before(split: str = SPLIT):
    return F.col("date_time") < F.lit(split).cast("timestamp_ntz")


def dump_of(games: DataFrame, users: DataFrame) -> str:
    """A dump rendered from these games, in a folder of its own."""
    return dump_games(games, users)


# P3-P10, each applied to the raw tag text parsed from a rendered dump:
# key -> (raw tag columns, column function, name of the games column it restores)
def code_functions():
    from ..functions import codes as K
    return {
        "event_code": (["Event"], K.event_code, "event"),
        "result_code": (["Result"], K.result_code, "result"),
        "termination_code": (["Termination"], K.termination_code, "termination"),
        "time_control": (["TimeControl"], K.time_control, "timecontrol"),
        "rating_parse": (["WhiteRatingDiff"], K.rating_parse, "whiteratingdiff"),
        "site_id": (["Site"], K.site_id, "game_id"),
        "game_timestamp": (["UTCDate", "UTCTime"], K.game_timestamp, "date_time"),
        "analyzed_flag": (["moves"], K.analyzed_flag, "analyzed"),
    }


def pgn_code(spark: SparkSession, games: DataFrame, users: DataFrame, key: str) -> DataFrame:
    """One P-row function over the raw tags of the whole rendered dump:
    (game id, raw text, parsed value)."""
    raw_cols, fn, out = code_functions()[key]
    tags = parse_tags(read_pgn(spark, dump_of(games, users)))
    raw = raw_cols[0] if len(raw_cols) == 1 else None
    raw_col = F.col(raw) if raw else F.concat_ws(" ", *raw_cols)
    return tags.select(F.regexp_extract("Site", r"org/(.*)", 1).alias("site"),
                       raw_col.alias("raw"), fn(*[F.col(c) for c in raw_cols]).alias(out))


def pgn_scan(spark: SparkSession, games: DataFrame, users: DataFrame) -> DataFrame:
    """S1 + P1-P11 + F1-F3 + E2 on a rendered dump: must give ``games`` back."""
    tags = parse_tags(read_pgn(spark, dump_of(games, users)))
    good, _ = games_from_tags(tags, users)
    return good.select(*GAMES_COLUMNS)


def pgn_dirty(spark: SparkSession, games: DataFrame, users: DataFrame) -> DataFrame:
    """F1-F3 and the unknown codes of P3-P7 on a dump with faults and odd layouts: games
    that come through, and the rejects with their reason."""
    path = dump_games(games, users, dirty_records)
    tags = join_open(cut(parse_tags(read_pgn(spark, path)), "tags"))
    good, bad = games_from_tags(tags, users)
    cols = ["site", "event", "result", "whiteelo", "timecontrol"]
    return good.select(*cols, F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select(*cols, "reason"))


def pgn_tags(spark: SparkSession, games: DataFrame, users: DataFrame) -> DataFrame:
    """Raw tag values as parsed from the dump text."""
    tags = parse_tags(read_pgn(spark, dump_of(games, users)))
    return tags.select(*[F.col(t).alias(t.lower()) for t in TAGS], "moves")


def appearances(games: DataFrame, users: DataFrame) -> DataFrame:
    """(username, date_time, site, slot): White before Black within a game."""
    uw = users.select(F.col("id").alias("white"), F.col("username").alias("_w"))
    ub = users.select(F.col("id").alias("black"), F.col("username").alias("_b"))
    g = games.join(uw, "white").join(ub, "black")
    s = F.explode(F.array(F.struct(F.col("_w").alias("username"), F.lit(0).alias("slot")),
                          F.struct(F.col("_b").alias("username"), F.lit(1).alias("slot"))))
    return g.select("date_time", "site", s.alias("n")).select(
        "n.username", "date_time", "site", "n.slot")


ORDER = ("date_time", "site", "slot")


def assign_user_ids(games: DataFrame, users: DataFrame) -> DataFrame:
    """E1 from scratch: ids 1..n by first appearance."""
    return assign_ids(appearances(games, users), None, ORDER)


def assign_user_ids_incremental(games: DataFrame, users: DataFrame) -> DataFrame:
    """E1 as a second load: ids of the games before the split exist; names
    first seen later continue from the maximum id."""
    before = _before(ID_SPLIT)
    early = assign_ids(appearances(games.filter(before), users), None, ORDER)
    return assign_ids(appearances(games.filter(~before), users), early, ORDER)


def encode(games: DataFrame, users: DataFrame) -> DataFrame:
    """Names -> ids against the dimension."""
    uw = users.select(F.col("id").alias("white"), F.col("username").alias("white_name"))
    ub = users.select(F.col("id").alias("black"), F.col("username").alias("black_name"))
    named = games.join(uw, "white").join(ub, "black").drop("white", "black")
    return encode_players(named, users).select("site", "white", "black")


def games_upsert(games: DataFrame) -> DataFrame:
    """K3: the stored table holds the games before the split; the batch holds
    every game from one year earlier on, twice (the second copy altered and
    later in input order).  Inserted: each new game once, first copy."""
    existing = with_partition(games.filter(_before()))
    overlap = games.filter(F.col("date_time") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    first = overlap.withColumn("copy", F.lit(0))
    second = overlap.withColumn("whiteelo", F.col("whiteelo") + 1).withColumn("copy", F.lit(1))
    batch = with_partition(first.unionByName(second))
    fresh = upsert_ignore(batch, existing, "site", ["copy", "date_time"])
    return fresh.select(*GAMES_COLUMNS)


def games_upsert_moved(games: DataFrame) -> DataFrame:
    """K3 with a batch that brings every third game 40 days later than stored: the
    id decides, not the month, so no stored game comes in again."""
    existing = with_partition(games.filter(_before()))
    third = F.col("site").cast("long") % 3 == 0
    moved = games.withColumn("date_time", F.when(
        third, F.col("date_time") + F.make_dt_interval(days=F.lit(40))).otherwise(F.col("date_time")))
    return upsert_ignore(with_partition(moved), existing, "site", ["date_time"]).select(*GAMES_COLUMNS)


def users_upsert(games: DataFrame, users: DataFrame) -> DataFrame:
    """K4: dimension members not yet stored (stored = players of the games
    before the split); a renamed duplicate later in the batch loses."""
    early = games.filter(_before(ID_SPLIT))
    stored_ids = early.select(F.col("white").alias("id")).union(early.select(F.col("black")))
    existing = users.join(stored_ids.distinct(), "id", "left_semi")
    batch = users.withColumn("copy", F.lit(0)).unionByName(
        users.withColumn("username", F.concat("username", F.lit("~"))).withColumn("copy", F.lit(1)))
    return upsert_ignore(batch, existing, "id", ["copy"]).select("id", "username")


def _manifest(spark: SparkSession, games: DataFrame) -> DataFrame:
    path = scratch_path(spark, "manifest")
    manifest_from_games(games).coalesce(1).write.text(path)
    return read_manifest(spark, path)


def month_manifest(spark: SparkSession, games: DataFrame, years=(1996, 1997, 1998)) -> DataFrame:
    """S2 on a manifest file listing one dump per month of ``games``."""
    return select_months(_manifest(spark, games), years).drop("url")


def months_pending(spark: SparkSession, games: DataFrame) -> DataFrame:
    """S3: ledger = files of the months before the split."""
    sel = select_months(_manifest(spark, games))
    ledger = sel.filter(F.col("year") < 1997).select("file")
    return pending_months(sel, ledger).drop("url")


BRACKET_SCHEMA = T.StructType([T.StructField("elo_bracket", T.StringType()),
                               T.StructField("bracket_lower", T.IntegerType()),
                               T.StructField("total_games", T.LongType())])


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: run SQL reports over the registered views into named CSV folders,
    then read them back."""
    from ..sources.results import run_queries
    from ..sources.tables import register_views
    register_views(spark, sf_dir)
    out = run_queries(spark, ["SELECT event, count(*) AS count FROM games GROUP BY event",
                              "SELECT count(*) AS count FROM games"],
                      scratch_path(spark, "reports"), names=["per_event", "total"])
    schema = T.StructType([T.StructField("event", T.StringType()),
                           T.StructField("count", T.LongType())])
    total = read_result(spark, out["total"], T.StructType(schema.fields[1:]))
    return read_result(spark, out["per_event"], schema).unionByName(
        total.withColumn("event", F.lit("all")))


def csv_roundtrip(spark: SparkSession, games: DataFrame) -> DataFrame:
    """K5 + S7: a report written as CSV with header and read back typed."""
    path = write_result(games_per_bracket(games), scratch_path(spark, "csv"))
    return read_result(spark, path, BRACKET_SCHEMA)


PLAYER_GAMES_SCHEMA = T.StructType([T.StructField("player", T.IntegerType()),
                                    T.StructField("total_games", T.LongType())])


def ordered_export(spark: SparkSession, games: DataFrame) -> DataFrame:
    """O1: players by games played, then id, exported over several files; read back with each
    row's place."""
    totals = games_per_player(games).select(F.col("white").alias("player"), "total_games")
    path = write_result(totals, scratch_path(spark, "ordered"), [F.desc("total_games"), "player"])
    return read_ordered(spark, path, PLAYER_GAMES_SCHEMA)


def ordered_brackets(spark: SparkSession, games: DataFrame) -> DataFrame:
    """O3: the rating brackets in their own order, which is not that of their names."""
    path = write_result(games_per_bracket(games), scratch_path(spark, "brackets"), ["bracket_lower"])
    return read_ordered(spark, path, BRACKET_SCHEMA)


# --- streaming -----------------------------------------------------------------
PARTITIONS = "spark.sql.shuffle.partitions"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
STATE_PER_CORE = 4


def _run(stream: DataFrame, **conf: str) -> DataFrame:
    from ..streaming.stream import run_to_table
    spark = stream.sparkSession
    out = scratch_path(spark, "stream-out")
    with settings(spark, conf):
        run_to_table(stream, out, scratch_path(spark, "stream-ckpt"))
    return spark.read.parquet(out)


def _to_games(parsed: DataFrame, users: DataFrame) -> DataFrame:
    from ..operators.keys import encode_players
    from ..operators.validate import complete_games, split_rejects, valid_games
    good, _ = split_rejects(encode_players(valid_games(complete_games(parsed)), users))
    return good.select(*GAMES_COLUMNS)


def stream_parse(spark: SparkSession, games: DataFrame, users: DataFrame) -> DataFrame:
    """T4: dump files streamed from a landing folder, a file for each core a micro-batch, parsed
    as in batch."""
    from ..streaming.stream import game_stream
    cores = spark.sparkContext.defaultParallelism
    out = _run(game_stream(spark, dump_of(games, users), max_files=cores).drop("file", "block", "pos"))
    return _to_games(out, users)


def _quarter(spark: SparkSession) -> int:
    """Files of a micro-batch that takes in a quarter of a dump and still feeds every core."""
    return dump_files(spark)


def stream_dedup(spark: SparkSession, games: DataFrame, users: DataFrame) -> DataFrame:
    """T5: the whole dump delivered twice, a quarter of its files a micro-batch, files in order
    of the game ids and so out of order in time; duplicates by id are dropped.

    The dump is rendered once.  The second delivery has the same files under other names, which the
    stream does not know: it goes on from its checkpoint and reads them all again.  The state, an
    entry for each game, is kept off the JVM heap, in ``STATE_PER_CORE`` partitions a core at most: each is opened
    and closed in every micro-batch, and a micro-batch commits the changes alone."""
    from ..streaming.stream import dedup, game_stream, run_to_table
    quarter = _quarter(spark)
    landing, out, checkpoint = (scratch_path(spark, x) for x in ("landing", "stream-out", "stream-ckpt"))
    dump_games(games, users, path=f"{landing}/first", files=4 * quarter)
    partitions = min(STATE_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get(PARTITIONS)))
    with settings(spark, {STATE_STORE: ROCKSDB, CHANGELOG: "true", PARTITIONS: str(partitions)}):
        for delivery in ("first", "second"):
            if delivery == "second":
                rename(f"{landing}/first", f"{landing}/second", spark)
            run_to_table(dedup(game_stream(spark, f"{landing}/*", max_files=quarter), without=("file", "block", "pos")),
                         out, checkpoint)
    return _to_games(spark.read.parquet(out), users)


def stream_upsert(spark: SparkSession, games: DataFrame, users: DataFrame) -> DataFrame:
    """foreachBatch ingest, a quarter of the files a micro-batch, run twice over the same
    files (the second run with a fresh checkpoint, i.e. a full replay): nothing is inserted twice."""
    from ..plans.ingest import load_games, load_users
    from ..streaming.stream import start_upsert
    quarter = _quarter(spark)
    dump = dump_games(games, users, order="date_time", files=4 * quarter)
    root = scratch_path(spark, "tables")
    for _ in range(2):
        start_upsert(spark, dump, root, scratch_path(spark, "ckpt"), max_files=quarter) \
            .awaitTermination()
    # the load assigned its own dense ids: compare through the user names
    own = load_users(spark, root)
    stored = load_games(spark, root)
    named = (stored.join(own.select(F.col("id").alias("white"), F.col("username").alias("white_name")),
                         "white")
             .join(own.select(F.col("id").alias("black"), F.col("username").alias("black_name")),
                   "black").drop("white", "black"))
    return encode_players(named, users).select(*GAMES_COLUMNS)


def stream_replay(spark: SparkSession, games: DataFrame, users: DataFrame) -> DataFrame:
    """Dump lines as keyed messages; summarised as messages per tag."""
    from ..streaming.stream import replay_lines
    log = spark.read.parquet(replay_lines(spark, dump_of(games, users),
                                          scratch_path(spark, "log")))
    kind = F.when(F.col("value").startswith("["),
                  F.regexp_extract("value", r"^\[(\w+)", 1)).otherwise(F.lit("moves"))
    return log.groupBy(kind.alias("tag")).agg(F.count(F.lit(1)).alias("lines"))


def stream_assemble(spark: SparkSession, games: DataFrame, users: DataFrame) -> DataFrame:
    """T2 + T3: line messages -> keyed state rebuilds the games -> parse."""
    from ..streaming.stream import assemble, line_stream, replay_lines
    log = replay_lines(spark, dump_of(games, users), scratch_path(spark, "log"))
    # a micro-batch has a file of each key; more state partitions than keys would only be opened and closed
    keys = dump_files(spark)
    recs = _run(assemble(line_stream(spark, log, max_files=keys)),
                **{PARTITIONS: str(min(keys, int(spark.conf.get(PARTITIONS))))})
    tags = parse_tags(recs.select(F.col("key").alias("file"), F.lit(0).cast("long").alias("block"),
                                  F.col("offset").alias("pos"), "raw"))
    good, _ = games_from_tags(tags, users)
    return good.select(*GAMES_COLUMNS)
