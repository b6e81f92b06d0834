"""Q1-Q17 and the fact queries (A1-A5, A12, A20, A21, O4, O5) over ``games``.

Every function takes the ``games`` fact frame (and the ``user_ids``
dimension where names are shown) and returns a lazy DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import (date_parts, day_name, minute_of_day, time_string)
from ..functions.ratings import bracket_label, bracket_lower
from ..operators.players import games_per_player, player_rows
from ..operators.ranking import exact_quantiles
from ..operators.stage import cut
from ..operators.stats import quantile_bin, rank0, share

STABLE_DIFF = 30
HISTORY_COLUMNS = ["event", "white", "black", "whiteratingdiff", "blackratingdiff",
                   "whiteelo", "blackelo", "date_time", "site"]


# --- Q1 ---------------------------------------------------------------------
def user_games(games: DataFrame, users: DataFrame, n: int = 100,
               max_diff: int = STABLE_DIFF) -> DataFrame:
    """Q1: n games of players as white and n as black, with user names.

    The original takes "any" n rows; here the first n by game id, so the
    answer is deterministic.  The top-n runs before the join (each task
    keeps n rows, ``TakeOrderedAndProject``); the dimension join then sees
    2n rows.  Valid because every player id in ``games`` is a member of
    ``user_ids`` (ids are assigned before games are written)."""
    parts = []
    for side in ("white", "black"):
        top = F.broadcast(games.filter(F.col(f"{side}ratingdiff") < max_diff)
                          .orderBy("site").limit(n))  # n rows: a proven bound
        parts.append(top.join(users, top[side] == users["id"], "inner"))
    return parts[0].unionByName(parts[1])


# --- Q2 family ----------------------------------------------------------------
def games_by_minute(games: DataFrame) -> DataFrame:
    """Q2: games per weekday (0 = Sunday) x hour x minute."""
    return (games.groupBy(*date_parts(F.col("date_time")))
            .agg(F.count("date_time").alias("number_of_games")))


def with_minute_fields(by_minute: DataFrame) -> DataFrame:
    """Weekday name, minute of day and HH:MM:SS text."""
    return by_minute.select(
        day_name(F.col("day")).alias("day"), "hour", "minute",
        minute_of_day(F.col("hour"), F.col("minute")).alias("time_int"),
        time_string(F.col("hour"), F.col("minute")).alias("time_str"),
        "number_of_games")


def games_by_halfhour(games: DataFrame, bins: int = 48) -> DataFrame:
    """Games per quantile bin of the minute of day (48 bins), with the
    0-based rank of each bin by games (W3, W4)."""
    m = cut(with_minute_fields(games_by_minute(games)), "minutes")  # <= 10,080 rows
    binned = quantile_bin(m, "time_int", bins, "time_group")
    per_bin = binned.groupBy("time_group").agg(
        F.sum("number_of_games").alias("number_of_games"))
    return rank0(per_bin, "number_of_games", "time_group")


def games_by_day(games: DataFrame) -> DataFrame:
    """Games per weekday name."""
    m = with_minute_fields(games_by_minute(games))
    return m.groupBy("day").agg(F.sum("number_of_games").alias("number_of_games"))


def minute_series(games: DataFrame) -> DataFrame:
    """Q2d: games per weekday name and minute of day."""
    return with_minute_fields(games_by_minute(games)).select(
        "day", "time_int", "time_str", "number_of_games")


# --- Q3-Q10 -------------------------------------------------------------------
def player_history(games: DataFrame, player: int) -> DataFrame:
    """Q3: every game of one player (either colour); the disjunction is
    pushed to the Parquet scan."""
    return (games.filter((F.col("white") == player) | (F.col("black") == player))
            .select(*HISTORY_COLUMNS).orderBy("event", "date_time"))


def games_per_bracket(games: DataFrame) -> DataFrame:
    """Q5: games per bracket of the lower of the two ratings."""
    lo = F.least("whiteelo", "blackelo")
    return (games.groupBy(bracket_label(lo).alias("elo_bracket"),
                          bracket_lower(lo).alias("bracket_lower"))
            .agg(F.count(F.lit(1)).alias("total_games")))


def games_per_event(games: DataFrame) -> DataFrame:
    """Q7: games per event code."""
    return games.groupBy("event").agg(F.count(F.lit(1)).alias("count"))


def analyzed_per_bracket(games: DataFrame) -> DataFrame:
    """Analysed and total games per bracket and the percentage."""
    lo = F.least("whiteelo", "blackelo")
    g = games.groupBy(bracket_label(lo).alias("elo_bracket"),
                      bracket_lower(lo).alias("bracket_lower")).agg(
        F.sum(F.col("analyzed").cast("long")).alias("analyzed_games"),
        F.count(F.lit(1)).alias("total_games"))
    return g.withColumn("pct_analyzed",
                        F.col("analyzed_games") / F.col("total_games") * 100.0)


def player_view(games: DataFrame) -> DataFrame:
    """Q9: player, elo, event, date_time for both sides of every game."""
    return player_rows(games).select("player", "elo", "event", "date_time")


def rating_span(games: DataFrame, max_diff: int = STABLE_DIFF) -> DataFrame:
    """Q10: lowest / highest stable rating and first / last stable game per
    player and event (F4: |diff| < 30)."""
    p = player_rows(games).filter(F.abs("diff") < max_diff)
    return p.groupBy("player", "event").agg(
        F.min("elo").alias("min_elo"), F.max("elo").alias("max_elo"),
        F.min("date_time").alias("first_game"), F.max("date_time").alias("last_game"))


def daily_rating(games: DataFrame, event: str = "B", sides=("white", "black"),
                 max_diff: int = STABLE_DIFF) -> DataFrame:
    """Q11: daily minimum stable rating per player in one time control, with
    days since the player's first stable day.

    The start day is a window minimum over the player's *daily* rows (at most
    one row per calendar day), not a self-join of the raw games."""
    p = (player_rows(games, sides=sides)
         .filter((F.col("event") == event) & (F.abs("diff") < max_diff)))
    daily = p.groupBy("player", F.to_date("date_time").alias("_d")).agg(
        F.min("elo").alias("min_elo"))
    start = F.min("_d").over(Window.partitionBy("player"))
    # the calendar day is kept as a midnight timestamp
    return daily.select("player", F.col("_d").cast("timestamp_ntz").alias("day"), "min_elo",
                        F.datediff("_d", start).alias("days_since_start"))


def blitz_pairs(games: DataFrame, until_year: int, event: str = "B") -> DataFrame:
    """Q12: pairings of one time control up to a year (inclusive).

    Written as a range on ``date_time`` so the predicate reaches the scan
    (``year(x) <= y`` would not be pushed)."""
    end = F.lit(f"{until_year + 1}-01-01 00:00:00").cast("timestamp_ntz")
    if "event_month" in games.columns:  # the stored table: prune its partitions
        games = games.filter(F.col("event_month") <= f"{until_year}-12")
    return (games.filter((F.col("event") == event) & (F.col("date_time") < end))
            .select("black", "white", "blackelo", "whiteelo", "date_time"))


# --- Q13-Q17 ------------------------------------------------------------------
def _titled_maxima(games: DataFrame, nonbot: bool, event: str | None):
    """Both colours' maxima in one scan (one scalar sub-query of a struct).
    ``title <> 'BOT'`` is false for NULL titles, so only titled players count."""
    def side_max(side):
        cond = F.lit(True)
        if nonbot:
            cond = cond & (F.col(f"{side}title") != "BOT")
        if event:
            cond = cond & (F.col("event") == event)
        return F.max(F.when(cond, F.col(f"{side}elo"))).alias(side)
    m = games.select(F.struct(side_max("black"), side_max("white"))).scalar()
    return m["black"], m["white"]


def rating_records(games: DataFrame, users: DataFrame, nonbot: bool = False,
                   event: str | None = None) -> DataFrame:
    """Q13-Q15: games holding the highest rating of either colour, with both
    names.  The maxima are scalar sub-queries; the (tiny) filtered result is
    joined to the dimension twice -- AQE broadcasts it at run time."""
    bmax, wmax = _titled_maxima(games, nonbot, event)
    hit = games.filter((F.col("blackelo") == bmax) | (F.col("whiteelo") == wmax))
    ub = users.select(F.col("id").alias("_bid"), F.col("username").alias("black_name"))
    uw = users.select(F.col("id").alias("_wid"), F.col("username").alias("white_name"))
    return (hit.join(ub, hit["black"] == ub["_bid"]).join(uw, hit["white"] == uw["_wid"])
            .drop("_bid", "_wid"))


def rating_low(games: DataFrame, users: DataFrame) -> DataFrame:
    """Q16: the lowest rating ever held, by whom."""
    p = player_rows(games, extra=())
    low = p.select(F.min("elo")).scalar()
    hit = p.filter(F.col("elo") == low).select("player", "elo").distinct()
    return hit.join(users, hit["player"] == users["id"]).select("player", "username", "elo")


# --- facts --------------------------------------------------------------------
def table_counts(games: DataFrame, users: DataFrame) -> DataFrame:
    """A1: number of games and of users (two scalar sub-queries)."""
    g = games.select(F.count(F.lit(1)).alias("games"))
    return g.select("games", users.select(F.count(F.lit(1))).scalar().alias("users"))


def date_range(games: DataFrame) -> DataFrame:
    """A2."""
    return games.agg(F.min("date_time").alias("first_game"),
                     F.max("date_time").alias("last_game"))


def terminations_by_event(games: DataFrame) -> DataFrame:
    """A3."""
    return games.groupBy("event", "termination").agg(F.count(F.lit(1)).alias("count"))


def provisional_games(games: DataFrame, limit: int = STABLE_DIFF) -> DataFrame:
    """Games with a provisional white rating, with either side
    provisional (|diff| > 30), and the share of all games."""
    w = F.abs("whiteratingdiff") > limit
    b = F.abs("blackratingdiff") > limit
    g = games.agg(F.count_if(w).alias("white_provisional"),
                  F.count_if(w | b).alias("either_provisional"),
                  F.count(F.lit(1)).alias("total_games"))
    return g.withColumn("pct_either", F.col("either_provisional") * 100.0 / F.col("total_games"))


def analyzed_share(games: DataFrame) -> DataFrame:
    """A5: share of analysed games."""
    return games.agg(F.avg(F.when(F.col("analyzed"), 1).otherwise(0)).alias("analyzed_share"))


def games_per_player_stats(games: DataFrame) -> DataFrame:
    """Median / mean / max games per player (exact median, distributed)."""
    t = cut(games_per_player(games), "totals")  # one row per player, read three times
    med = exact_quantiles(t, [], "total_games", {"median_games": 0.5})
    return med.select("median_games",
                      t.select(F.avg("total_games")).scalar().alias("mean_games"),
                      t.select(F.max("total_games")).scalar().alias("max_games"))


def elo_p90(games: DataFrame, p: float = 0.9) -> DataFrame:
    """Percentile of the players' latest ratings (ties in time -> game id)."""
    rows = player_rows(games, extra=("date_time", "site"))
    last = rows.groupBy("player").agg(
        F.max_by("elo", F.struct("date_time", "site")).alias("elo"))
    return exact_quantiles(last, [], "elo", {"elo_p90": p})


def top_player_per_event(games: DataFrame, users: DataFrame) -> DataFrame:
    """Most active player of each time control (ties -> lower id), named.

    ``max_by`` inside one groupBy(event): partial aggregation per task, so no
    event's players are gathered in one task."""
    t = games_per_player(games, keys=("event",))
    best = t.groupBy("event").agg(
        F.max_by(F.struct("white", "total_games"),
                 F.struct("total_games", -F.col("white"))).alias("b"))
    best = F.broadcast(best.select("event", F.col("b.white").alias("player"),
                                   F.col("b.total_games").alias("total_games")))  # one per event
    return best.join(users, best["player"] == users["id"]).select(
        "event", "player", "username", "total_games")


def top_players(games: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """The k most active players with names (top-k before the join)."""
    t = F.broadcast(games_per_player(games).orderBy(F.desc("total_games"), "white").limit(k))
    return t.join(users, t["white"] == users["id"]).select(
        F.col("white").alias("player"), "username", "total_games")


def players_above(games: DataFrame, users: DataFrame, above: int) -> DataFrame:
    """Players with more than ``above`` games, with names."""
    t = games_per_player(games).filter(F.col("total_games") > above)
    return t.join(users, t["white"] == users["id"]).select(
        F.col("white").alias("player"), "username", "total_games")


def user_ids_all(users: DataFrame) -> DataFrame:
    """Q17 / S6."""
    return users.select("id", "username")


def share_per_bracket(games: DataFrame) -> DataFrame:
    return share(games_per_bracket(games), "total_games")


def share_per_event(games: DataFrame) -> DataFrame:
    return share(games_per_event(games), "count")
