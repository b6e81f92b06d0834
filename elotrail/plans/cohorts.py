"""Rating-trajectory cohorts built on the daily series of Q11.

Chain: daily (player, day) -> monthly (player, month) -> banded by the
month-0 rating -> per-player net change -> band statistics and curves.
Every step is keyed by player (bounded by the number of months a player was
active), so the shuffles partition by player; per-band statistics use
partial aggregates or the range-sliced order statistics of
:mod:`elotrail.operators.ranking`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import months_since_start
from ..functions.ratings import band_lower, bround_gain, start_band
from ..operators.players import games_per_player
from ..operators.stage import cut
from ..operators.ranking import average_rank_pct, exact_quantiles
from ..operators.stats import hex_bins, marginals, mean_ci, share, snap_nearest
from ..sources.results import write_result
from .queries import daily_rating

# Percentiles the trajectories are snapped to.
PERCENTILES = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


def _first_value(value: str, order: str):
    """The player's value at the smallest ``order`` -- a window over the
    player's own rows (at most one per day or month), so it reuses the
    partitioning by player instead of a self-join."""
    return F.min_by(value, order).over(Window.partitionBy("player"))


def daily_curve(daily: DataFrame) -> DataFrame:
    """Band by day-0 rating, mean +- CI per (days since start, band)."""
    banded_rows = daily.withColumn(
        "band", start_band(_first_value("min_elo", "days_since_start"))
    ).filter(F.col("band").isNotNull())
    return mean_ci(banded_rows, ["days_since_start", "band"], "min_elo")


def monthly_rating(daily: DataFrame) -> DataFrame:
    """Mean of the daily minima per (player, month since start)."""
    return (daily.groupBy("player",
                          months_since_start(F.col("days_since_start")).alias("months_since_start"))
            .agg(F.avg("min_elo").alias("rating")))


def banded(monthly: DataFrame) -> DataFrame:
    """Monthly series with the starting band (month-0 rating, half-open);
    players outside 800-2399 are dropped (F12).

    Month 0 always exists (the start day is day 0), so the start rating is
    the value at the player's smallest month: a window on the partitioning
    by player that the daily series already has -- no join, no shuffle."""
    start = _first_value("rating", "months_since_start")
    return (monthly.withColumn("start_rating", start)
            .withColumn("band", start_band(F.col("start_rating")))
            .filter(F.col("band").isNotNull())
            .withColumn("band_lower", band_lower(F.col("band"))))


def net_change(banded_df: DataFrame) -> DataFrame:
    """Start rating, last month's rating, net change and months
    active per player, in one groupBy(player) (min_by / max_by, no join)."""
    return banded_df.groupBy("player", "band", "band_lower").agg(
        F.min_by("rating", "months_since_start").alias("start_rating"),
        F.max_by("rating", "months_since_start").alias("end_rating"),
        F.max("months_since_start").alias("months_since_start")).withColumn(
        "diff", F.col("end_rating") - F.col("start_rating"))


def band_stats(net: DataFrame) -> DataFrame:
    """Median, mean, min, max of the final rating and of the net
    change per band (exact medians via range-sliced ranking).

    ``net`` (one row per player) feeds two aggregations; it is written
    once as a lineage cut instead of being recomputed from the games.  Both
    measures are ranked in one pass, as rows (measure, band, value)."""
    net = cut(net.select("band", "end_rating", "diff"), "net-change")
    basic = net.groupBy("band").agg(
        F.avg("end_rating").alias("mean_rating"), F.avg("diff").alias("mean_diff"),
        F.min("end_rating").alias("min_rating"), F.min("diff").alias("min_diff"),
        F.max("end_rating").alias("max_rating"), F.max("diff").alias("max_diff"))
    values = net.unpivot("band", [F.col("end_rating").cast("double").alias("rating"),
                                  F.col("diff").cast("double").alias("diff")], "measure", "value")
    medians = exact_quantiles(values, ["measure", "band"], "value", {"median": 0.5})
    wide = medians.groupBy("band").agg(*[
        F.max(F.when(F.col("measure") == m, F.col("median"))).alias(f"median_{m}") for m in ("rating", "diff")])
    return basic.join(wide, "band")


def gain_curve(banded_df: DataFrame, net: DataFrame, cutoff: float = -1000) -> DataFrame:
    """Mean rating +- CI per (band, month) over players whose net change
    exceeds ``cutoff`` (F10 semi-join), with the number of players."""
    keep = net.filter(F.col("diff") > cutoff).select("player")
    rows = banded_df.join(keep, "player", "left_semi")
    return mean_ci(rows, ["band", "months_since_start"], "rating") \
        .withColumnRenamed("n", "players")


def cohort_size(net: DataFrame, cutoffs=(-1000, 100, 800)) -> DataFrame:
    """Players whose net change exceeds each cutoff (``net`` has one row per
    player, so they are distinct)."""
    return (net.select(F.explode(F.array(*[F.lit(c) for c in cutoffs])).alias("cutoff"), "diff")
            .groupBy("cutoff").agg(F.count_if(F.col("diff") > F.col("cutoff")).alias("players")))


def gain_matrix(net: DataFrame) -> DataFrame:
    """A16 in long form: the wide band x gain matrix with its empty cells as 0."""
    wide = gain_pivot(net)
    cells = [c for c in wide.columns if c != "band"]
    return (wide.unpivot("band", [f"`{c}`" for c in cells], "gain", "players")
            .select("band", F.col("gain").cast("double").alias("gain"),
                    F.coalesce("players", F.lit(0)).alias("players")))


def export_band_stats(net: DataFrame, out_dir: str) -> dict[str, str]:
    """K6: one CSV file each of the bands' medians, means, minima and maxima of rating
    and net change, in the order of the bands."""
    stats = cut(band_stats(net), "band-stats")
    out = {}
    for name in ("median", "mean", "min", "max"):
        part = stats.select("band", F.col(f"{name}_rating").alias("rating"),
                            F.col(f"{name}_diff").alias("diff"))
        order = F.split("band", " ")[0].cast("int")
        out[name] = write_result(part.orderBy(order).coalesce(1), f"{out_dir}/{name}")
    return out


def gain_heatmap(net: DataFrame) -> DataFrame:
    """C8 + C9 / A15: players and mean months per (band, gain rounded
    half-even to 100) for non-negative net change; long form."""
    pos = net.filter(F.col("diff") >= 0).withColumn("gain", bround_gain(F.col("diff")))
    return pos.groupBy("band", "gain").agg(
        F.count(F.lit(1)).alias("players"),
        F.bround(F.avg("months_since_start"), 0).alias("months"))


def gain_pivot(net: DataFrame, measure: str = "players") -> DataFrame:
    """Wide band x gain matrix (columns = rounded gains).  The pivot
    values are listed first (a small distinct), so the pivot is bounded."""
    long = gain_heatmap(net)
    values = [r[0] for r in long.select("gain").distinct().orderBy("gain").collect()]
    return long.groupBy("band").pivot("gain", values).agg(F.first(measure))


def gain_percentile(net: DataFrame) -> DataFrame:
    """Percentile (average rank / n) of the net change within band."""
    return average_rank_pct(cut(net, "net-change"), ["band"], "diff", "percentile")


def percentile_curves(banded_df: DataFrame, net: DataFrame,
                      pcts=PERCENTILES) -> DataFrame:
    """C11: mean curve per (band, snapped percentile, month)."""
    p = gain_percentile(net).select("player", snap_nearest(F.col("percentile"), list(pcts))
                                    .alias("percentile"))
    rows = banded_df.join(p, "player", "inner")
    return mean_ci(rows, ["band", "percentile", "months_since_start"], "rating")


def players_per_band(net: DataFrame) -> DataFrame:
    """Players per starting band and their share."""
    return share(net.groupBy("band").agg(F.count(F.lit(1)).alias("players")), "players")


def months_to_gain(curve: DataFrame, points: float = 100, skip_first: bool = False) -> DataFrame:
    """C13 (flagship): first month in which a band's mean curve is at least
    ``points`` above its start (month 0, or month 1 when ``skip_first``).

    ``curve`` is small (bands x months); the start is a per-band min_by."""
    first = 1 if skip_first else 0
    c = curve.filter(F.col("months_since_start") >= first)
    start = c.groupBy("band").agg(F.min_by("mean", "months_since_start").alias("start_rating"))
    j = c.join(start, "band")
    return j.groupBy("band", "start_rating").agg(
        F.min(F.when(F.col("mean") >= F.col("start_rating") + points,
                     F.col("months_since_start"))).alias("months_to_gain")) \
        .withColumn("points", F.lit(float(points)))


def games_vs_gain(games: DataFrame, net: DataFrame, y: str = "diff",
                  per_month: bool = False, gridsize: int = 50) -> DataFrame:
    """Hexagonal density of total games (all time controls, log x) vs net
    change or final rating; ``per_month`` divides both by months active
    (zero months -> NULL -> dropped)."""
    return hex_bins(_games_and_gain(games, net, y, per_month), "x", "y", gridsize=gridsize, log_x=True)


def games_vs_gain_marginals(games: DataFrame, net: DataFrame, y: str = "diff",
                            per_month: bool = False) -> DataFrame:
    """Counts along each axis of the density."""
    return marginals(_games_and_gain(games, net, y, per_month), "x", "y")


def _games_and_gain(games: DataFrame, net: DataFrame, y: str, per_month: bool) -> DataFrame:
    totals = games_per_player(games).withColumnRenamed("white", "player")
    j = totals.join(net, "player", "inner")
    x = F.col("total_games").cast("double")
    yv = F.col("diff") if y == "diff" else F.col("end_rating")
    if per_month:
        m = F.col("months_since_start").cast("double")
        x = F.try_divide(x, m)
        yv = F.try_divide(yv, m) if y == "diff" else yv
    return cut(j.select(x.alias("x"), yv.alias("y")).dropna(), "hex-points")


def extreme_gains(net: DataFrame, k: int = 5) -> DataFrame:
    """K largest and smallest net changes, k best changes per month."""
    net = cut(net.select("player", "diff", "months_since_start"), "net-change")
    per_month = F.try_divide(F.col("diff"), F.col("months_since_start"))
    parts = [
        net.orderBy(F.desc("diff"), "player").limit(k).select(
            F.lit("max_gain").alias("kind"), "player", F.col("diff").alias("value")),
        net.orderBy("diff", "player").limit(k).select(
            F.lit("min_gain").alias("kind"), "player", F.col("diff").alias("value")),
        net.withColumn("_pm", per_month).filter(F.col("_pm").isNotNull())
        .orderBy(F.desc("_pm"), "player").limit(k).select(
            F.lit("max_gain_per_month").alias("kind"), "player", F.col("_pm").alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- chain helpers ------------------------------------------------------------
def chain(games: DataFrame, sides=("white", "black"), materialize: bool = False):
    """daily -> monthly -> banded -> net, for one set of games.

    A report that reads both the banded monthly series and the net change made
    from it has it written once (``materialize``), so the games are read once; a
    report that reads one of them keeps the partitioning by player instead."""
    daily = daily_rating(games, sides=sides)
    monthly = monthly_rating(daily)
    b = banded(monthly)
    if materialize:
        b = cut(b, "banded")
    return daily, monthly, b, net_change(b)
