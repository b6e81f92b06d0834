"""A player owning a third of all games: per-player operators stay exact
(checked against pandas) and aggregate map-side before the shuffle."""

from pyspark.sql import functions as F

from elotrail.operators.players import games_per_player
from elotrail.operators.ranking import average_rank_pct
from elotrail.plans import cohorts as C
from elotrail.plans import queries as Q
from elotrail.sources.tables import games

HOT = 7


def skewed(spark):
    g = games(spark, "/root/testdata/sf0.01")
    hot = F.col("site").cast("long") % 3 == 0  # fixture construction only
    return g.withColumn("white", F.when(hot, F.lit(HOT)).otherwise(F.col("white")))


def test_games_per_player_with_hot_player(spark):
    g = skewed(spark)
    got = {r["white"]: r["total_games"] for r in games_per_player(g).collect()}
    pdf = g.select("white", "black").toPandas()
    w, b = pdf["white"].value_counts(), pdf["black"].value_counts()
    both = w.index.intersection(b.index)
    want = {int(k): int(w[k] + b[k]) for k in both}
    assert got == want and got[HOT] > len(pdf) // 3


def test_partial_aggregation_before_shuffle(spark):
    p = games_per_player(skewed(spark))._jdf.queryExecution().executedPlan().toString()
    lines = p.splitlines()
    ex = next(i for i, ln in enumerate(lines) if "Exchange hashpartitioning" in ln)
    assert any("HashAggregate" in ln and "partial_count" in ln for ln in lines[ex + 1:])


def test_daily_series_and_ranks_with_hot_player(spark):
    g = skewed(spark)
    daily = Q.daily_rating(g).toPandas()
    hot = daily[daily["player"] == HOT]
    assert hot["day"].is_unique and (hot["days_since_start"] >= 0).all()
    _, _, _, net = C.chain(g, materialize=False)
    got = average_rank_pct(net, ["band"], "diff").toPandas()
    want = got.assign(p2=got.groupby("band")["diff"].rank(pct=True))
    assert (want["percentile"] - want["p2"]).abs().max() < 1e-12


def test_hot_value_is_split_in_the_join_back(spark):
    """Most players have a net change of 0: the join of ranks back on (band, diff) splits
    that value's partition once it is large against the others."""
    low = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
           "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
           "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
           "spark.sql.adaptive.coalescePartitions.enabled": "false",
           "spark.sql.autoBroadcastJoinThreshold": "-1",
           "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in low}
    for k, v in low.items():
        spark.conf.set(k, v)
    try:
        net = spark.range(200_000).select(
            F.col("id").alias("player"), F.lit("800 - 999").alias("band"),
            F.when(F.col("id") % 3 > 0, 0.0).otherwise(F.col("id") * 1.0).alias("diff"))
        out = average_rank_pct(net, ["band"], "diff")
        assert out.agg(F.count(F.lit(1))).first()[0] == 200_000
        out.write.format("noop").mode("overwrite").save()
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
