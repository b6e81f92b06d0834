"""PGN dumps -> one row per game -> typed ``games`` rows.

A dump is text: per game a block of ``[Key "Value"]`` lines and a movetext line
that starts with ``1``; blank lines, line ends (``\\n``, ``\\r\\n``) and the order of the
tags vary.  Splitting the text on ``\\n[Event `` gives one row per game straight
from the (bz2-splittable) text reader, so parsing is a projection -- no per-line
state machine, no Python.  A row that holds more than one game (no ``[Event``
between them) is split again behind each closing line.  Tags that stand above
their game's ``[Event`` line come out as an ``open`` row, which ``join_open`` adds to
the row after it.  The tag block is cut off once and its lines are read in one
pass; the last line of a repeated tag counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codes import (analyzed_flag, event_code, game_timestamp, rating_parse,
                               result_code, site_id, termination_code, time_control)

RECORD_SEP = "\n[Event "
BOM = "\ufeff"
# a line that ends a game: movetext, or a result without moves
CLOSING = r"\n(?:1|0-1|\*)"
GAME = rf"(?s).+?(?:{CLOSING}[^\n]*|\z)"
# Tags the games table keeps (everything else -- Date, Round,
# Opening, unknown tags -- is ignored).
TAGS = ["Event", "Site", "White", "Black", "Result", "UTCDate", "UTCTime", "WhiteElo",
        "BlackElo", "WhiteRatingDiff", "BlackRatingDiff", "WhiteTitle", "BlackTitle", "ECO",
        "TimeControl", "Termination"]


def read_pgn(spark: SparkSession, paths) -> DataFrame:
    """(file, block, pos, raw, open) -- one row per game record.

    ``(file, block, pos)`` is the record's position in the input, captured
    at the scan before any shuffle; it orders first appearances for E1."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return with_position(split_records(spark.read.option("lineSep", RECORD_SEP).text(paths)))


def with_position(records: DataFrame) -> DataFrame:
    """Add ``pos``: ascending inside a split of the input, without gaps."""
    return records.select("file", "block", F.monotonically_increasing_id().alias("pos"), "raw", "open")


def split_records(text: DataFrame) -> DataFrame:
    """(file, block, raw, open) of text that was read with ``RECORD_SEP``.

    The ``[Event `` that the reader took off is put back.  Only a row without
    movetext, or with a tag line behind its movetext, is looked at for further
    games.  ``open``: tags without an ``[Event`` line that nothing closes yet."""
    raw = F.col("value")
    raw = F.when(raw.startswith('"'), F.concat(F.lit("[Event "), raw)).when(
        raw.startswith(BOM), F.substring(raw, 2, 1 << 30)).otherwise(raw)
    more = F.coalesce(F.get(at_movetext(F.col("raw")), F.lit(1)).contains("\n["), F.lit(True))
    games = F.when(more, F.regexp_extract_all("raw", F.lit(GAME), F.lit(0))).otherwise(F.array("raw"))
    rows = text.select(F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_block_start").alias("block"), raw.alias("raw"))
    rows = rows.select("file", "block", F.explode(games).alias("raw"))
    whole = F.col("raw").contains("\n1") | F.col("raw").startswith("[Event ") | F.col("raw").rlike(CLOSING)
    return rows.select("file", "block", "raw", (~whole).alias("open")).filter(
        F.col("raw").startswith("[") | F.col("raw").contains("\n["))


# the value ends at the first "] of its line; nothing in it is tried twice
TAG_LINE = r'(?m)^\[(\w++) "([^"\n]*+(?:"(?!\])[^"\n]*+)*+)"\]'


def at_movetext(raw: Column) -> Column:
    """The lines before the movetext, which is the first line that starts with 1, and what
    comes after that 1; one element without a movetext."""
    return F.split(raw, "\n1", 2)


def movetext(rest: Column) -> Column:
    """The movetext line of the text behind its 1, NULL without one.  Blank lines and
    notes before it are passed over."""
    return F.rtrim(F.concat(F.lit("1"), F.substring_index(rest, "\n", 1)), F.lit("\r"))


def parse_tags(records: DataFrame) -> DataFrame:
    """Wanted tags as raw strings plus the movetext line.

    Names and values are arrays read from the header once per record; a tag is
    the value at the name's last place, missing or empty -> NULL.  The explode
    of a one-element array keeps the optimiser from copying the parse into
    filters above it, and the generated methods short enough to be compiled."""
    at = [c for c in ("file", "block", "pos", "open") if c in records.columns]
    # the place goes through the struct too: a constant one, copied upwards, made a long method
    head = F.struct(*at, F.reverse(F.regexp_extract_all("head", F.lit(TAG_LINE), F.lit(1))).alias("k"),
                    F.reverse(F.regexp_extract_all("head", F.lit(TAG_LINE), F.lit(2))).alias("v"),
                    F.col("moves"))
    once = (records.select(*at, F.explode(F.array(at_movetext(F.col("raw")))).alias("parts"))
            .select(*at, F.col("parts")[0].alias("head"), movetext(F.get("parts", F.lit(1))).alias("moves"))
            .select(F.explode(F.array(head)).alias("r")))

    def tag(name: str) -> Column:
        at = F.array_position("r.k", name).cast("int")
        return F.nullif(F.get("r.v", at - 1), F.lit("")).alias(name)

    return once.select(*[F.col(f"r.{c}").alias(c) for c in at], *[tag(t) for t in TAGS], F.col("r.moves").alias("moves"))


def join_open(tags: DataFrame) -> DataFrame:
    """Add the tags of each ``open`` row to the row after it, in its split or in the next split
    of the file that has rows; the later line of a repeated tag counts.  One with no row after it stays, as
    a record that no movetext closes.

    ``tags`` is read several times: a written table (``cut``).  Dumps with ``[Event`` first have no
    open rows and cost one look at that column."""
    opens = tags.filter("open")
    if opens.isEmpty():
        return tags.drop("open")
    ends = tags.groupBy("file", "block").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    later = Window.partitionBy("file").orderBy("block")
    ends = ends.select("file", "block", "_last", F.lead("_first").over(later).alias("_next"))
    heads = opens.join(ends, ["file", "block"]).withColumn(
        "_to", F.when(F.col("pos") < F.col("_last"), F.col("pos") + 1).otherwise(F.col("_next")))
    ahead = heads.filter("_to IS NOT NULL").select(
        F.col("_to").alias("pos"), *[F.col(t).alias(f"_{t}") for t in TAGS])
    whole = tags.filter("NOT open").join(ahead, "pos", "left").select(
        "file", "block", "pos", *[F.coalesce(t, f"_{t}").alias(t) for t in TAGS], "moves")
    return whole.unionByName(heads.filter("_to IS NULL").select(*whole.columns))


def encode_games(tags: DataFrame) -> DataFrame:
    """Typed codes; players stay user names until E2.

    The explode of a one-element array parts the look-up of the tags from the checks and joins
    above it: as one projection they were a generated method too long for the JVM to compile."""
    typed = F.struct(
        "file", "block", "pos",
        event_code(F.coalesce(F.col("Event"), F.lit(""))).alias("event"),
        site_id(F.col("Site")).alias("site"),
        F.col("White").alias("white_name"),
        F.col("Black").alias("black_name"),
        result_code(F.coalesce(F.col("Result"), F.lit(""))).alias("result"),
        rating_parse(F.col("WhiteElo")).alias("whiteelo"),
        rating_parse(F.col("BlackElo")).alias("blackelo"),
        rating_parse(F.col("WhiteRatingDiff")).alias("whiteratingdiff"),
        rating_parse(F.col("BlackRatingDiff")).alias("blackratingdiff"),
        F.col("ECO").alias("eco"),
        F.when(F.col("TimeControl").isNotNull(), time_control(F.col("TimeControl")))
         .alias("timecontrol"),
        F.when(F.col("Termination").isNotNull(), termination_code(F.col("Termination")))
         .alias("termination"),
        F.col("WhiteTitle").alias("whitetitle"),
        F.col("BlackTitle").alias("blacktitle"),
        analyzed_flag(F.col("moves")).alias("analyzed"),
        game_timestamp(F.col("UTCDate"), F.col("UTCTime")).alias("date_time"),
        F.col("moves"))
    return tags.select(F.explode(F.array(typed)).alias("_typed")).select("_typed.*")
