"""The player-perspective view of games (one row per game and side)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDES = ("white", "black")


def player_rows(games: DataFrame, sides=SIDES, extra=("event", "date_time")) -> DataFrame:
    """One row per (game, side): player, elo, diff, side, plus ``extra`` columns.

    Written as ``explode(array(struct...))`` so the games are scanned once
    (a UNION ALL of two projections scans the table twice).
    """
    structs = [F.struct(F.col(s).alias("player"), F.col(f"{s}elo").alias("elo"),
                        F.col(f"{s}ratingdiff").alias("diff"), F.lit(s).alias("side"))
               for s in sides]
    one = structs[0] if len(structs) == 1 else F.explode(F.array(*structs))
    return games.select(*extra, one.alias("p")).select("p.*", *extra)


def games_per_player(games: DataFrame, keys=(), both_colours: bool = True) -> DataFrame:
    """Total games per player (and ``keys``), one shuffle, no join.

    ``both_colours`` keeps the inner-join semantics of the original report:
    a player seen with one colour only is not listed.  Partial aggregation
    runs map-side, so a very active player does not skew the shuffle.
    """
    p = player_rows(games, extra=tuple(keys))
    agg = p.groupBy("player", *keys).agg(
        F.count_if(F.col("side") == "white").alias("_w"),
        F.count_if(F.col("side") == "black").alias("_b"))
    if both_colours:
        agg = agg.filter((F.col("_w") > 0) & (F.col("_b") > 0))
    return agg.select(F.col("player").alias("white"), *keys,
                      (F.col("_w") + F.col("_b")).alias("total_games"))
