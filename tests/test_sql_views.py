"""The tables answer plain SQL through spark.sql exactly like the DataFrame
reports (a user can keep writing the SQL they write today)."""


from elotrail.operators.players import games_per_player
from elotrail.plans import queries as Q
from elotrail.sources.tables import games, register_views
from tests.conftest import SF_SMALL


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sql_reports_match_dataframe_reports(spark):
    register_views(spark, SF_SMALL)
    g = games(spark, SF_SMALL)
    assert rows(spark.sql("SELECT event, count(*) AS count FROM games GROUP BY event")) \
        == rows(Q.games_per_event(g))
    spark.sql("""SELECT g.event, g.date_time, s.* FROM games g LATERAL VIEW inline(array(
        struct(white AS player, whiteelo AS elo, whiteratingdiff AS diff, true AS first),
        struct(black AS player, blackelo AS elo, blackratingdiff AS diff, false AS first))) s""").createOrReplaceTempView("sides")
    both = spark.sql("""SELECT player, count(*) FROM sides GROUP BY player
                        HAVING bool_or(first) AND bool_or(NOT first)""")
    assert rows(both) == rows(games_per_player(g))
    span = spark.sql("""SELECT player, event, min(elo), max(elo), min(date_time), max(date_time)
        FROM sides WHERE abs(diff) < 30 GROUP BY player, event""")
    assert rows(span) == rows(Q.rating_span(g))
    pairs = spark.sql("""SELECT black, white, blackelo, whiteelo, date_time FROM games
        WHERE event = 'B' AND date_trunc('YEAR', date_time) < TIMESTAMP '2000-01-01'""")
    assert rows(pairs) == rows(Q.blitz_pairs(g, 1999))


def test_stored_tables_as_views(spark, tmp_path):
    from elotrail.plans.ingest import init_tables, register_tables
    root = str(tmp_path / "db")
    init_tables(spark, root)
    register_tables(spark, root)
    assert spark.sql("SELECT count(*) FROM games").first()[0] == 0
    assert spark.table("user_ids").columns == ["id", "username"]
