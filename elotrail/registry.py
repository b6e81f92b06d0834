"""Registered queries: key -> callable(spark, sf_dir) -> DataFrame.

Parameters chosen for the shipped test tables (dates 1995-2001): Q3 follows
player 42, Q12 stops at 1999.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import date_parts
from .functions.ratings import bracket_label, bracket_lower, start_band
from .operators import stats
from .operators.players import games_per_player
from .operators.stage import cut
from .plans import cohorts as C
from .plans import loads as L
from .plans import queries as Q
from .session import scratch_path
from .sources.results import read_result
from .sources.tables import games, user_ids

PLAYER = 42
UNTIL_YEAR = 1999
GAIN_POINTS = 100
ABOVE_GAMES = 25

Query = Callable[[SparkSession, str], DataFrame]


def _g(f):
    return lambda spark, d: f(games(spark, d))


def _gu(f):
    return lambda spark, d: f(games(spark, d), user_ids(spark, d))


def _chain(pick, both=False):
    """A report on the cohort chain; ``both``: it reads the series and the net change."""
    def run(spark, d):
        g = games(spark, d)
        daily, monthly, banded, net = C.chain(g, materialize=both)
        return pick(g, daily, monthly, banded, net)
    return run


def _hex(y, per_month):
    return _chain(lambda g, d, m, b, n: C.games_vs_gain(g, n, y=y, per_month=per_month))


def _months_to_gain(skip_first):
    return _chain(lambda g, d, m, b, n: C.months_to_gain(
        cut(C.gain_curve(b, n, -1000), "curve"), GAIN_POINTS, skip_first), both=True)


def _band_stats_export(spark, d):
    """K6, read back: one row per statistic and band."""
    _, _, _, net = C.chain(games(spark, d))
    schema = "band string, rating double, diff double"
    out = None
    for name, path in C.export_band_stats(net, scratch_path(spark, "band-stats")).items():
        part = read_result(spark, path, schema).withColumn("stat", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


REGISTRY: dict[str, Query] = {
    # named SQL reports
    "q01_user_games": _gu(Q.user_games),
    "q02_games_by_minute": _g(Q.games_by_minute),
    "q02b_games_by_halfhour": _g(Q.games_by_halfhour),
    "q02c_games_by_day": _g(Q.games_by_day),
    "q02d_minute_series": _g(Q.minute_series),
    "q03_player_history": _g(lambda g: Q.player_history(g, PLAYER)),
    "q04_games_per_player": _g(games_per_player),
    "q05_games_per_bracket": _g(Q.games_per_bracket),
    "q06_games_per_player_event": _g(lambda g: games_per_player(g, keys=("event",))),
    "q07_games_per_event": _g(Q.games_per_event),
    "q08_analyzed_per_bracket": _g(Q.analyzed_per_bracket),
    "q09_player_rows": _g(Q.player_view),
    "q10_rating_span": _g(Q.rating_span),
    "q11_daily_rating": _g(Q.daily_rating),
    "q11_daily_rating_black": _g(lambda g: Q.daily_rating(g, sides=("black",))),
    "q12_blitz_pairs": _g(lambda g: Q.blitz_pairs(g, UNTIL_YEAR)),
    "q13_rating_records": _gu(Q.rating_records),
    "q14_rating_records_nonbot": _gu(lambda g, u: Q.rating_records(g, u, nonbot=True)),
    "q15_rating_records_blitz": _gu(lambda g, u: Q.rating_records(g, u, nonbot=True, event="B")),
    "q16_rating_low": _gu(Q.rating_low),
    "user_ids_all": lambda spark, d: Q.user_ids_all(user_ids(spark, d)),
    # facts
    "table_counts": _gu(Q.table_counts),
    "date_range": _g(Q.date_range),
    "terminations_by_event": _g(Q.terminations_by_event),
    "provisional_games": _g(Q.provisional_games),
    "analyzed_share": _g(Q.analyzed_share),
    "games_per_player_stats": _g(Q.games_per_player_stats),
    "elo_p90": _g(Q.elo_p90),
    "top_player_per_event": _gu(Q.top_player_per_event),
    "top_players": _gu(Q.top_players),
    "players_above": _gu(lambda g, u: Q.players_above(g, u, ABOVE_GAMES)),
    "share_per_bracket": _g(Q.share_per_bracket),
    "share_per_event": _g(Q.share_per_event),
    "games_histogram": _g(lambda g: stats.histogram(
        cut(games_per_player(g), "totals"), "total_games")),
    "games_log_ecdf": _g(lambda g: stats.log_ecdf(
        cut(games_per_player(g), "totals"), "total_games")),
    # cohorts
    "c01_daily_curve": _g(lambda g: C.daily_curve(Q.daily_rating(g))),
    "c02_monthly_rating": _g(lambda g: C.monthly_rating(Q.daily_rating(g))),
    "c03_banded_rating": _chain(lambda g, d, m, b, n: b),
    "c04_net_change": _chain(lambda g, d, m, b, n: n),
    "c05_band_stats": _chain(lambda g, d, m, b, n: C.band_stats(n)),
    "c06_mean_ci": _chain(lambda g, d, m, b, n: C.gain_curve(b, n, -1000), both=True),
    "c06_mean_ci_100": _chain(lambda g, d, m, b, n: C.gain_curve(b, n, 100), both=True),
    "c06_mean_ci_800": _chain(lambda g, d, m, b, n: C.gain_curve(b, n, 800), both=True),
    "c06_cohort_size": _chain(lambda g, d, m, b, n: C.cohort_size(n)),
    "c07_games_vs_gain": _hex("diff", False),
    "c07_games_vs_elo": _hex("elo", False),
    "c07_per_month": _hex("diff", True),
    "c07_elo_per_month": _hex("elo", True),
    "c07_marginals": _chain(lambda g, d, m, b, n: C.games_vs_gain_marginals(g, n)),
    "c08_gain_count_heatmap": _chain(
        lambda g, d, m, b, n: C.gain_heatmap(n).select("band", "gain", "players")),
    "c09_gain_time_heatmap": _chain(
        lambda g, d, m, b, n: C.gain_heatmap(n).select("band", "gain", "months")),
    "gain_matrix": _chain(lambda g, d, m, b, n: C.gain_matrix(n)),
    "band_stats_export": _band_stats_export,
    "c10_gain_percentile": _chain(lambda g, d, m, b, n: C.gain_percentile(n)),
    "c11_percentile_curves": _chain(lambda g, d, m, b, n: C.percentile_curves(b, n), both=True),
    "share_per_band": _chain(lambda g, d, m, b, n: C.players_per_band(n)),
    "semi_gainers": _chain(
        lambda g, d, m, b, n: b.join(n.filter(F.col("diff") > GAIN_POINTS), "player",
                                     "left_semi"), both=True),
    "extreme_gains": _chain(lambda g, d, m, b, n: C.extreme_gains(n)),
    "c13_months_to_gain": _months_to_gain(False),
    "c13_skip_first": _months_to_gain(True),
    # load path
    "pgn_scan": lambda spark, d: L.pgn_scan(spark, games(spark, d), user_ids(spark, d)),
    "pgn_tags": lambda spark, d: L.pgn_tags(spark, games(spark, d), user_ids(spark, d)),
    "assign_user_ids": _gu(L.assign_user_ids),
    "assign_user_ids_incremental": _gu(L.assign_user_ids_incremental),
    "encode_players": _gu(L.encode),
    "games_upsert": _g(L.games_upsert),
    "games_upsert_moved": _g(L.games_upsert_moved),
    "pgn_dirty": lambda spark, d: L.pgn_dirty(spark, games(spark, d), user_ids(spark, d)),
    "users_upsert": _gu(L.users_upsert),
    "month_manifest": lambda spark, d: L.month_manifest(spark, games(spark, d)),
    "pending_months": lambda spark, d: L.months_pending(spark, games(spark, d)),
    "csv_roundtrip": lambda spark, d: L.csv_roundtrip(spark, games(spark, d)),
    "csv_export": L.csv_export,
    "ordered_export": lambda spark, d: L.ordered_export(spark, games(spark, d)),
    "ordered_brackets": lambda spark, d: L.ordered_brackets(spark, games(spark, d)),
    # per-row functions
    **{k: (lambda key: lambda spark, d: L.pgn_code(spark, games(spark, d), user_ids(spark, d),
                                                    key))(k) for k in L.code_functions()},
    "elo_bracket": _g(lambda g: g.select(
        "site", bracket_label(F.least("whiteelo", "blackelo")).alias("elo_bracket"),
        bracket_lower(F.least("whiteelo", "blackelo")).alias("bracket_lower"))),
    "date_parts": _g(lambda g: g.select("site", *date_parts(F.col("date_time")),
                                        F.year("date_time").alias("year"))),
    "start_band": _g(lambda g: C.monthly_rating(Q.daily_rating(g))
                     .filter(F.col("months_since_start") == 0)
                     .select("player", "rating", start_band(F.col("rating")).alias("band"))),
    # streaming
    "stream_parse": lambda spark, d: L.stream_parse(spark, games(spark, d), user_ids(spark, d)),
    "stream_dedup": lambda spark, d: L.stream_dedup(spark, games(spark, d), user_ids(spark, d)),
    "stream_upsert": lambda spark, d: L.stream_upsert(spark, games(spark, d), user_ids(spark, d)),
    "stream_replay": lambda spark, d: L.stream_replay(spark, games(spark, d), user_ids(spark, d)),
    "stream_assemble": lambda spark, d: L.stream_assemble(spark, games(spark, d),
                                                          user_ids(spark, d)),
}
