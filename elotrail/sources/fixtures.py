"""Render ``games`` rows as PGN text (test fixtures and round-trip queries).

A Spark job: one formatted string per game, written as bz2 text files to a
scratch folder under the shared checkpoint directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# Codes back to the tag text of a dump.
EVENT_NAMES = {"B": "Rated Blitz game", "b": "Rated Bullet game", "c": "Rated Classical game",
               "R": "Rated Rapid game", "C": "Rated Correspondence game", "?": "Casual game"}
RESULT_TEXT = {"W": "1-0", "B": "0-1", "D": "1/2-1/2", "?": "*"}
TERMINATION_TEXT = {"N": "Normal", "F": "Time forfeit", "A": "Abandoned", "?": "Rules infraction"}
SITE_PREFIX = "https://example.org/"
FILES_PER_CORE = 2  # files of a dump written at once by one core, one after the other


def _map(c: Column, table: dict[str, str]) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'[{name} "'), value, F.lit('"]'))


def _signed(c: Column) -> Column:
    """The number with its sign, as ``%+d`` gives it (``null`` without one), but no formatter per row."""
    text = c.cast("string")
    return F.coalesce(F.when(c >= 0, F.concat(F.lit("+"), text)).otherwise(text), F.lit("null"))


def with_names(games: DataFrame, users: DataFrame) -> DataFrame:
    """Games with the names of both players."""
    uw = users.select(F.col("id").alias("white"), F.col("username").alias("_wname"))
    ub = users.select(F.col("id").alias("black"), F.col("username").alias("_bname"))
    return games.join(uw, "white").join(ub, "black")


def render_tags(games: DataFrame, users: DataFrame) -> DataFrame:
    """Raw tag strings per game (names from the dimension, time control as
    ``base+inc`` with the fixture's rule: inc = id mod 5, base = rest)."""
    return tags_of(with_names(games, users))


def tags_of(named: DataFrame) -> DataFrame:
    """``render_tags`` of games that have their players' names."""
    k = F.col("site").cast("long")
    inc = k % 5
    when = F.col("date_time").cast("string")
    return named.select(
        F.col("site").alias("_key"),
        F.col("date_time").alias("_ts"),
        _map(F.col("event"), EVENT_NAMES).alias("Event"),
        F.concat(F.lit(SITE_PREFIX), F.col("site")).alias("Site"),
        F.col("_wname").alias("White"), F.col("_bname").alias("Black"),
        _map(F.col("result"), RESULT_TEXT).alias("Result"),
        F.translate(F.substring(when, 1, 10), "-", ".").alias("UTCDate"),
        F.substring(when, 12, 8).alias("UTCTime"),
        F.col("whiteelo").cast("string").alias("WhiteElo"),
        F.col("blackelo").cast("string").alias("BlackElo"),
        _signed(F.col("whiteratingdiff")).alias("WhiteRatingDiff"),
        _signed(F.col("blackratingdiff")).alias("BlackRatingDiff"),
        F.col("whitetitle").alias("WhiteTitle"),
        F.col("blacktitle").alias("BlackTitle"),
        F.col("eco").alias("ECO"),
        F.concat((F.col("timecontrol") - inc * 40).cast("string"), F.lit("+"),
                 inc.cast("string")).alias("TimeControl"),
        _map(F.col("termination"), TERMINATION_TEXT).alias("Termination"),
        F.col("analyzed"))


def render_records(tags: DataFrame) -> DataFrame:
    """One PGN record per row (tag block, blank line, movetext, blank line --
    the text writer adds the final newline)."""
    order = ["Event", "Site", "Date", "White", "Black", "Result", "UTCDate", "UTCTime",
             "WhiteElo", "BlackElo", "WhiteRatingDiff", "BlackRatingDiff", "WhiteTitle",
             "BlackTitle", "ECO", "Opening", "TimeControl", "Termination"]
    lines = []
    for name in order:
        if name == "Date":
            lines.append(_line("Date", F.col("UTCDate")))  # ignored by the parser
        elif name == "Opening":
            lines.append(_line("Opening", F.lit("King's Pawn Game")))
        else:
            lines.append(F.when(F.col(name).isNotNull(), _line(name, F.col(name))))
    moves = F.when(F.col("analyzed"),
                   F.lit("1. e4 { [%eval 0.17] } 1... e5 { [%eval 0.2] } 2. Nf3 "))\
        .otherwise(F.lit("1. e4 e5 2. Nf3 Nc6 "))
    text = F.concat_ws("\n", *lines)
    return tags.select("_key", "_ts", F.concat(text, F.lit("\n\n"), moves, F.col("Result"),
                                        F.lit("\n")).alias("value"))


def dirty_records(tags: DataFrame) -> DataFrame:
    """Records with the faults and odd layouts of real dumps, by game id modulo 13:
    an unknown rating, a missing change, a time control of ``-``, one without ``+``, an
    unknown event, an unknown result, a note before the moves, a second blank line, moves
    right after the tags, a repeated rating tag, and no moves at all.  Beside that, by the id
    div 13 modulo 5: no blank line between games, a line of one space there, ``\\r\\n`` line ends,
    and the site above the event."""
    k = F.col("_key").cast("long") % 13
    t = (tags.withColumn("WhiteElo", F.when(k == 1, F.lit("?")).otherwise(F.col("WhiteElo")))
         .withColumn("BlackRatingDiff", F.when(k != 2, F.col("BlackRatingDiff")))
         .withColumn("TimeControl", F.when(k == 3, F.lit("-")).when(k == 4, F.lit("600"))
                     .otherwise(F.col("TimeControl")))
         .withColumn("Event", F.when(k == 5, F.lit("Casual Chess960")).otherwise(F.col("Event")))
         .withColumn("Result", F.when(k == 6, F.lit("*")).otherwise(F.col("Result"))))
    r = render_records(t)
    k = F.col("_key").cast("long") % 13
    blank = "\n\n1"
    v = F.col("value")
    v = (F.when(k == 7, F.replace(v, F.lit(blank), F.lit("\n\n { a note }\n1")))
         .when(k == 8, F.replace(v, F.lit(blank), F.lit("\n\n\n1")))
         .when(k == 9, F.replace(v, F.lit(blank), F.lit("\n1")))
         .when(k == 10, F.concat(F.substring_index(v, "\n\n", 1), F.lit('\n[WhiteElo "1234"]\n\n'),
                                 F.substring_index(v, "\n\n", -1)))
         .when(k == 11, F.concat(F.substring_index(v, "\n\n", 1), F.lit("\n\n0-1\n")))
         .otherwise(v))
    # the explode of a one-element array parts text and layout, as one generated method is too long to compile
    r = r.withColumn("value", F.explode(F.array(v)))
    v = F.col("value")
    layout = F.floor(F.col("_key").cast("long") / 13) % 5
    first = F.substring_index(v, "\n", 2)
    swapped = F.concat(F.substring_index(first, "\n", -1), F.lit("\n"), F.substring_index(first, "\n", 1),
                       F.substring(v, F.length(first) + 1, F.length(v)))
    v = (F.when(layout == 1, F.rtrim(v, F.lit("\n"))).when(layout == 2, F.concat(v, F.lit(" ")))
         .when(layout == 3, F.replace(v, F.lit("\n"), F.lit("\r\n"))).when(layout == 4, swapped).otherwise(v))
    return r.withColumn("value", v)


def write_dump(records: DataFrame, path: str | None = None, files: int | None = None,
               compression: str = "bzip2", order: str = "_key", mode: str = "overwrite") -> str:
    """Write records as ``files`` compressed text files ordered by game id
    (or by time with ``order="_ts"``, as real monthly dumps are)."""
    spark = records.sparkSession
    return _write(_deal(records, files or spark.sparkContext.defaultParallelism, order, "_key"),
                  path or scratch_path(spark, "pgn"), compression, mode)


def dump_games(games: DataFrame, users: DataFrame, records=render_records, path: str | None = None,
               files: int | None = None, order: str = "site", mode: str = "overwrite") -> str:
    """``write_dump`` of ``records(render_tags(games, users))``; ``order``: ``site`` or ``date_time``.

    The games are dealt to the files as typed rows and made text after that, so the shuffle and
    the look for its ranges, which reads its input a second time, do without the text.  Without
    ``files``, each core writes ``FILES_PER_CORE`` of them, so a slow one holds up little."""
    spark = games.sparkSession
    dealt = _deal(with_names(games, users), files or dump_files(spark), order, "site")
    return _write(records(tags_of(dealt)), path or scratch_path(spark, "pgn"), "bzip2", mode)


def dump_files(spark: SparkSession) -> int:
    return FILES_PER_CORE * spark.sparkContext.defaultParallelism


def _deal(rows: DataFrame, files: int, order: str, key: str) -> DataFrame:
    return rows.repartitionByRange(files, order, key).sortWithinPartitions(order, key)


def _write(records: DataFrame, path: str, compression: str, mode: str) -> str:
    records.select("value").write.mode(mode).option("compression", compression).text(path)
    return path
