"""O1 / O3: exports over several files keep their order."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from elotrail.plans.loads import PLAYER_GAMES_SCHEMA
from elotrail.sources.results import read_ordered, run_queries, write_result


@pytest.fixture
def many_files(spark):
    """Small partitions are not put together, so that exports have several files."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, old)


def concatenated(path):
    files = sorted(path.glob("part-*.csv"))
    assert len(files) >= 3
    return pd.concat([pd.read_csv(f) for f in files if f.stat().st_size])


def totals(spark, n=5000):
    return spark.range(n).select((F.col("id") * 7919 % n).cast("int").alias("player"),
                                 (F.col("id") * 31 % 97).cast("long").alias("total_games"))


def test_files_in_order_of_their_names(spark, tmp_path, many_files):
    out = tmp_path / "report"
    write_result(totals(spark), str(out), [F.desc("total_games"), "player"])
    got = concatenated(out)
    want = totals(spark).toPandas().sort_values(["total_games", "player"], ascending=[False, True])
    assert got.values.tolist() == want[["player", "total_games"]].values.tolist()
    back = read_ordered(spark, str(out), PLAYER_GAMES_SCHEMA).orderBy("position").toPandas()
    assert back["position"].tolist() == list(range(1, 5001))
    assert back[["player", "total_games"]].values.tolist() == got.values.tolist()


def test_sql_reports_keep_their_order(spark, tmp_path, many_files):
    totals(spark).createOrReplaceTempView("totals_of_test")
    out = run_queries(spark, "SELECT * FROM totals_of_test ORDER BY total_games, player DESC", str(tmp_path), ["r"])
    got = concatenated(tmp_path / "r")
    assert out["r"].endswith("/r")
    assert got.values.tolist() == got.sort_values(["total_games", "player"], ascending=[True, False]).values.tolist()


def test_brackets_by_their_bound(spark, tmp_path, many_files):
    rows = [("1000-1199", 1000, 5), ("800-999", 800, 1), ("2600+", 2600, 2), ("<800", 0, 3)]
    df = spark.createDataFrame(rows, "elo_bracket string, bracket_lower int, total_games long").repartition(3)
    write_result(df, str(tmp_path / "b"), ["bracket_lower"])
    got = read_ordered(spark, str(tmp_path / "b"), df.schema).orderBy("position")
    assert [r["elo_bracket"] for r in got.collect()] == ["<800", "800-999", "1000-1199", "2600+"]


def test_an_empty_report(spark, tmp_path):
    write_result(totals(spark).limit(0), str(tmp_path / "e"), ["player"])
    assert read_ordered(spark, str(tmp_path / "e"), PLAYER_GAMES_SCHEMA).count() == 0
