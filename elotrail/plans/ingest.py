"""Batch ingest: PGN dumps -> ``user_ids`` + ``games`` (+ rejects), idempotent.

    records -> tags (written once as a lineage cut: the bz2 text is decoded one time)
            -> E1 new users (all names, also of discarded games)
            -> P3-P11 -> F2 complete -> F1 valid -> E2 ids -> F3 rejects
            -> K3 first-wins, stored ids of the batch's months first -> append
            -> S3 the names of the files, last

Users are appended before games, so a game never refers to a missing user.
Ids are a deterministic function of (input, existing users): a re-run after
a crash re-derives the same ids, and K3/K4 turn repeated rows into no-ops.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.keys import assign_ids, encode_players, name_appearances
from ..operators.ranking import cumulative_before
from ..operators.stage import cut
from ..operators.upsert import upsert_ignore, upsert_ignore_near
from ..operators.validate import (RATING_COLUMNS, no_movetext, split_checked, valid_usernames,
                                  with_reason)
from ..schema import GAMES_COLUMNS, GAMES_SCHEMA, USERS_SCHEMA
from ..session import ensure_checkpoint_dir, exists, remove, temporary
from ..sources.manifest import pending_months, select_months
from ..sources.pgn import encode_games, join_open, parse_tags, read_pgn

ORDER = ("pos",)
SPLIT_ROWS = 1 << 33  # Spark numbers the rows of a task with so many places
PARTITION = "event_month"
COMPACT_BYTES = 128 << 20  # size of a stored file that compaction aims at
LEDGER_SCHEMA = "file string"
STORED_GAMES_SCHEMA = T.StructType(GAMES_SCHEMA.fields + [T.StructField(PARTITION, T.StringType())])


@dataclass
class Tables:
    root: str

    @property
    def games(self) -> str:
        return f"{self.root.rstrip('/')}/games"

    @property
    def users(self) -> str:
        return f"{self.root.rstrip('/')}/user_ids"

    @property
    def rejects(self) -> str:
        return f"{self.root.rstrip('/')}/rejects"

    @property
    def ledger(self) -> str:
        return f"{self.root.rstrip('/')}/loaded_files"

    @property
    def compaction(self) -> str:
        return f"{self.root.rstrip('/')}/compaction"


def _read_or_none(spark: SparkSession, path: str, schema) -> DataFrame | None:
    return spark.read.schema(schema).parquet(path) if exists(path, spark) else None


def init_tables(spark: SparkSession, root: str) -> Tables:
    """K1: create empty tables (declared schemas) if absent."""
    t = Tables(root)
    finish_compaction(spark, root)
    if _read_or_none(spark, t.users, USERS_SCHEMA) is None:
        spark.createDataFrame([], USERS_SCHEMA).write.mode("append").parquet(t.users)
    if _read_or_none(spark, t.games, STORED_GAMES_SCHEMA) is None:
        empty = spark.createDataFrame([], GAMES_SCHEMA).withColumn(PARTITION, F.lit(""))
        empty.write.mode("append").partitionBy(PARTITION).parquet(t.games)
    if _read_or_none(spark, t.ledger, LEDGER_SCHEMA) is None:
        spark.createDataFrame([], LEDGER_SCHEMA).write.mode("append").parquet(t.ledger)
    return t


def loaded_files(spark: SparkSession, root: str) -> DataFrame:
    """S3: the ledger, names of the dump files that were loaded to the end (``file``)."""
    t = Tables(root)
    ledger = _read_or_none(spark, t.ledger, LEDGER_SCHEMA)
    return spark.createDataFrame([], LEDGER_SCHEMA) if ledger is None else ledger.distinct()


def load_games(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(STORED_GAMES_SCHEMA).parquet(Tables(root).games)


def load_users(spark: SparkSession, root: str) -> DataFrame:
    """The whole dimension (never collected)."""
    return spark.read.schema(USERS_SCHEMA).parquet(Tables(root).users)


def check_games(tags: DataFrame, users: DataFrame) -> DataFrame:
    """Typed, id-encoded rows with the F3 ``reason``.  Games without numeric
    ratings are dropped (F1); a record that no movetext line closes (F2) is a
    reject with a reason."""
    rated = F.col(RATING_COLUMNS[0]).isNotNull()
    for c in RATING_COLUMNS[1:]:
        rated = rated & F.col(c).isNotNull()
    typed = encode_games(tags).filter(no_movetext() | rated)
    checked = with_reason(encode_players(typed, users))
    return checked.withColumn("reason", F.when(no_movetext(), "no movetext")
                              .otherwise(F.col("reason")))


def register_tables(spark: SparkSession, root: str) -> None:
    """S8 for stored tables: ``games`` and ``user_ids`` as SQL views."""
    load_games(spark, root).createOrReplaceTempView("games")
    load_users(spark, root).createOrReplaceTempView("user_ids")


def games_from_tags(tags: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed, validated, id-encoded games and the rejected rows."""
    return split_checked(check_games(tags, users))


def with_partition(games: DataFrame) -> DataFrame:
    """``yyyy-MM`` from the text form: date_format would go through the session's zone."""
    return games.withColumn(PARTITION, F.substring(F.col("date_time").cast("string"), 1, 7))


def ingest(spark: SparkSession, paths, root: str) -> dict:
    """Load PGN dumps into the tables under ``root``; returns row counts."""
    return ingest_tags(spark, parse_tags(read_pgn(spark, paths)), root)


def ingest_pending(spark: SparkSession, manifest: DataFrame, folder: str, root: str, years=None) -> list[str]:
    """S2 + S3: load the dumps of the manifest that the ledger does not have, month by month, oldest
    first, from ``folder``; returns their names.  A load that fails stops here, its file and those
    after it stay pending."""
    selected = select_months(manifest, years)
    pending = pending_months(selected, loaded_files(spark, root))
    done = []
    for row in pending.select("file").collect():  # names of dumps: one a month
        ingest(spark, f"{folder.rstrip('/')}/{row['file']}", root)
        record_files(spark, [row["file"]], root)
        done.append(row["file"])
    return done


def record_files(spark: SparkSession, files: list[str], root: str) -> None:
    """S3: add files to the ledger, those without records too; one named again changes nothing."""
    known = loaded_files(spark, root).filter(F.col("file").isin(files)).collect()
    new = sorted(set(files) - {r[0] for r in known})
    if new:
        path = Tables(root).ledger
        spark.createDataFrame([(f,) for f in new], LEDGER_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def ingest_tags(spark: SparkSession, tags: DataFrame, root: str) -> dict:
    """Shared by batch ingest and the streaming ``foreachBatch`` sink: parsed
    tag rows (with their input order) -> new users, new games, rejects."""
    ensure_checkpoint_dir(spark)
    with temporary(spark):
        return _load(spark, tags, init_tables(spark, root))


def _append(df: DataFrame, path: str, *partitions: str) -> int:
    """Append a cut frame and return its rows; an empty one writes no file.

    By partition, rows are rebalanced by bytes: small months share a task and give one file
    each, a large one is divided over as many tasks as its bytes fill
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``)."""
    n = df.count()
    if n and partitions:
        df.hint("rebalance", *partitions).write.mode("append").partitionBy(*partitions).parquet(path)
    elif n:
        df.write.mode("append").parquet(path)
    return n


def file_sizes(spark: SparkSession, root: str) -> DataFrame:
    """(event_month, files, bytes) of the stored games; no file is opened."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
             .schema("path string, modificationTime timestamp, length long, content binary, event_month string")
             .load(Tables(root).games))
    return files.groupBy(PARTITION).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def compact(spark: SparkSession, root: str, target: int = COMPACT_BYTES) -> list[str]:
    """K2: rewrite the months that have over twice the files that their bytes fill at ``target``
    bytes each; returns these months.  Run it between loads.

    The rewritten months are first written whole beside the table, then put in their place by
    a dynamic partition overwrite.  If that is interrupted, the next load or compaction
    does it again from the copy, so no month is lost."""
    finish_compaction(spark, root)
    need = F.greatest(F.lit(1), F.ceil(F.col("bytes") / target))
    sizes = file_sizes(spark, root).filter(F.col(PARTITION) != "").filter(F.col("files") > 2 * need)
    months = sorted(r[0] for r in sizes.select(PARTITION).collect())  # a few hundred at most
    if months:
        t = Tables(root)
        old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target))
        try:
            (load_games(spark, root).filter(F.col(PARTITION).isin(months)).hint("rebalance", PARTITION)
             .write.mode("overwrite").partitionBy(PARTITION).parquet(t.compaction))
        finally:
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
        finish_compaction(spark, root)
    return months


def finish_compaction(spark: SparkSession, root: str) -> None:
    """Put the copy of a compaction in place; one that was not written to its end goes."""
    t = Tables(root)
    if exists(f"{t.compaction}/_SUCCESS", spark):
        (spark.read.schema(STORED_GAMES_SCHEMA).parquet(t.compaction).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(PARTITION).parquet(t.games))
    if exists(t.compaction, spark):
        remove(t.compaction, spark)


def in_order(tags: DataFrame) -> DataFrame:
    """``pos`` as one number that orders all records by (file, block, place): the rank of
    the record's split, then its place.  The splits, one row each, are ranked by range slices and
    written; the join has no hint, the bytes of that table decide."""
    splits = tags.select("file", "block").distinct()
    ranks = cumulative_before(splits, [], ["file", "block"], small_groups=False)
    ranks = cut(ranks.select("file", "block", F.col("_before").alias("_rank")), "split-ranks")
    return (tags.join(ranks, ["file", "block"])
            .withColumn("pos", F.col("_rank") * SPLIT_ROWS + F.col("pos") % SPLIT_ROWS)
            .drop("_rank").select(*tags.columns))


def _load(spark: SparkSession, tags: DataFrame, t: Tables) -> dict:
    tags = cut(tags, "tags")  # lineage cut: the text is decoded once
    name = F.element_at(F.split("file", "/"), -1)
    files = [r[0] for r in tags.select(name).distinct().collect()]  # the dumps of a load
    tags = in_order(join_open(tags) if "open" in tags.columns else tags)
    existing_users = load_users(spark, t.root)
    # names the dimension cannot hold are left out *before* numbering, so the
    # ids stay dense; their games are rejected (no id) by the check below
    named = name_appearances(tags, ORDER).withColumn("place", F.col("pos") * 2 + F.col("slot"))
    new_users = assign_ids(valid_usernames(named), existing_users, ("place",))
    users_added = _append(cut(new_users, "new-users"), t.users)
    users = load_users(spark, t.root)
    # encoded once: the accepted games, their months and the rejects all
    # read this table
    checked = cut(with_partition(check_games(tags, users)), "checked")
    good, bad = split_checked(checked)
    bad = bad.drop(PARTITION)
    fresh = upsert_ignore_near(good, load_games(spark, t.root), "site", ORDER, PARTITION)
    # a large month is divided between the tasks that give its rows: of few files, by all cores
    cores = spark.sparkContext.defaultParallelism
    if len(checked.inputFiles()) < cores:
        fresh = fresh.repartition(cores)
    games_added = _append(fresh.select(*GAMES_COLUMNS, PARTITION), t.games, PARTITION)
    # rejects are keyed by their content, so a re-run adds none twice
    content = [c for c in bad.columns if c not in ("block", "pos")]
    bad = bad.withColumn("reject_key", F.sha2(F.to_json(F.struct(*content)), 256))
    stored = _read_or_none(spark, t.rejects, bad.schema)
    _append(cut(upsert_ignore(bad, stored, "reject_key", ORDER), "rejects"), t.rejects)
    # last: a load that failed before this did not happen for the ledger
    record_files(spark, files, t.root)
    return {"users_added": users_added, "games_added": games_added}
