"""Invariants of SURVEY §5.4 and distributed operators vs pandas."""

import pandas as pd
from pyspark.sql import functions as F

from elotrail.operators.ranking import average_rank_pct, exact_quantiles
from elotrail.operators.stats import quantile_bin, snap_nearest
from elotrail.plans import queries as Q
from elotrail.sources.tables import games
from tests.conftest import SF_SMALL


def test_counts_sum_to_games(spark):
    g = games(spark, SF_SMALL)
    n = g.count()
    assert Q.games_per_bracket(g).agg(F.sum("total_games")).first()[0] == n
    assert Q.games_per_event(g).agg(F.sum("count")).first()[0] == n
    assert Q.terminations_by_event(g).agg(F.sum("count")).first()[0] == n
    assert Q.player_view(g).count() == 2 * n


def test_average_rank_pct_matches_pandas(spark):
    pdf = pd.DataFrame({"band": ["a"] * 7 + ["b"] * 5,
                        "v": [3.0, 1.0, 3.0, 2.0, 3.0, 0.5, 9.0, 1.0, 1.0, 1.0, 2.0, 0.0]})
    pdf["id"] = range(len(pdf))
    got = average_rank_pct(spark.createDataFrame(pdf), ["band"], "v").toPandas()
    want = pdf.assign(percentile=pdf.groupby("band")["v"].rank(pct=True))
    m = got.merge(want, on="id")
    assert (m["percentile_x"] - m["percentile_y"]).abs().max() < 1e-12


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    vals = [5, 1, 1, 7, 3, 3, 3, 10, 2, 8, 8]
    df = spark.createDataFrame([(v,) for v in vals], "x int")
    out = exact_quantiles(df, [], "x", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).first()
    for name, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)):
        assert abs(out[name] - np.percentile(vals, p * 100)) < 1e-9


def test_quantile_bin_matches_qcut(spark):
    vals = [i * 7 % 100 for i in range(300)]
    pdf = pd.DataFrame({"x": vals})
    want = pd.qcut(pdf["x"], 10, labels=False, duplicates="drop")
    got = quantile_bin(spark.createDataFrame(pdf), "x", 10).toPandas()["bin"]
    assert list(got) == list(want)


def test_snap_nearest_ties_go_first(spark):
    targets = [0.01, 0.1, 0.25, 0.5]
    xs = [0.055, 0.3, 0.999, 0.175, 0.375, 0.05]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(snap_nearest(F.col("x"), targets)).collect()]
    assert got == [min(targets, key=lambda t: abs(t - x)) for x in xs]


def test_bround_half_even(spark):
    df = spark.createDataFrame([(50.0,), (150.0,), (250.0,), (249.0,)], "d double")
    got = [r[0] for r in df.select(F.bround("d", -2)).collect()]
    assert got == [round(50.0, -2), round(150.0, -2), round(250.0, -2), round(249.0, -2)]


def test_first_int_and_day_names(spark):
    from elotrail.functions.dates import day_name, first_int
    df = spark.createDataFrame([("3 days",), ("1 year 2 mons",), ("00:00:00",), ("none",)], "t string")
    assert [r[0] for r in df.select(first_int(F.col("t"))).collect()] == [3, 1, 0, None]
    d = spark.range(7).select(day_name(F.col("id").cast("int")))
    assert [r[0] for r in d.collect()][0::6] == ["Sunday", "Saturday"]


def test_gain_pivot_matches_long_form(spark):
    from elotrail.plans import cohorts as C
    from elotrail.sources.tables import games as G
    _, _, _, net = C.chain(G(spark, SF_SMALL))
    long = {(r["band"], float(r["gain"])): r["players"]
            for r in C.gain_heatmap(net).collect()}
    wide = C.gain_pivot(net).collect()
    cells = {(r["band"], float(k)): v for r in wide for k, v in r.asDict().items()
             if k != "band" and v is not None}
    assert cells == long


def test_cumulative_before_across_many_slices(spark):
    """Groups spanning several range slices get the same positions as a
    plain cumulative count."""
    import random
    from elotrail.operators.ranking import cumulative_before
    rnd = random.Random(7)
    rows = [(rnd.choice("abc"), rnd.randint(0, 40), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = cumulative_before(df, ["g"], ["v", "id"], num_partitions=7).toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "v", "id"]).sort_values(["g", "v", "id"])
    pdf["want"] = pdf.groupby("g").cumcount()
    pdf["total"] = pdf.groupby("g")["id"].transform("count")
    m = got.merge(pdf, on="id")
    assert (m["_before"] == m["want"]).all() and (m["_total"] == m["total"]).all()
