"""Declared schemas of the stored tables."""

from pyspark.sql import types as T

# Column order of the fact table, as in the declared DDL of the games table.
GAMES_SCHEMA = T.StructType([
    T.StructField("event", T.StringType(), False),
    T.StructField("site", T.StringType(), False),
    T.StructField("white", T.IntegerType(), False),
    T.StructField("black", T.IntegerType(), False),
    T.StructField("result", T.StringType(), False),
    T.StructField("whiteelo", T.IntegerType(), False),
    T.StructField("blackelo", T.IntegerType(), False),
    T.StructField("whiteratingdiff", T.IntegerType(), False),
    T.StructField("blackratingdiff", T.IntegerType(), False),
    T.StructField("eco", T.StringType(), False),
    T.StructField("timecontrol", T.IntegerType(), False),
    T.StructField("termination", T.StringType(), False),
    T.StructField("whitetitle", T.StringType(), True),
    T.StructField("blacktitle", T.StringType(), True),
    T.StructField("analyzed", T.BooleanType(), False),
    T.StructField("date_time", T.TimestampNTZType(), False),
])
GAMES_COLUMNS = [f.name for f in GAMES_SCHEMA.fields]

USERS_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("username", T.StringType(), False),
])

# Storage limits of the declared DDL (VARCHAR lengths, SMALLINT columns).
VARCHAR_LIMITS = {"event": 1, "site": 8, "result": 1, "eco": 3, "termination": 1,
                  "whitetitle": 3, "blacktitle": 3}
SMALLINT_COLUMNS = ("whiteelo", "blackelo", "whiteratingdiff", "blackratingdiff", "timecontrol")
USERNAME_MAX = 30
