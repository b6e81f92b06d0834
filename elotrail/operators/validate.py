"""Which parsed records become games, which are dropped or rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SMALLINT_COLUMNS, USERNAME_MAX, VARCHAR_LIMITS

RATING_COLUMNS = ["whiteelo", "blackelo", "whiteratingdiff", "blackratingdiff"]
NOT_NULL = ["event", "site", "white", "black", "result", "eco", "timecontrol",
            "termination", "analyzed", "date_time"]


def complete_games(df: DataFrame) -> DataFrame:
    """the record has a movetext line starting with '1' (a move-less
    '0-1' does not close a game and is dropped -- without leaking its tags)."""
    return df.filter(F.col("moves").startswith("1"))


def no_movetext():
    """F2 as a condition: nothing closes the record."""
    return ~F.coalesce(F.col("moves").startswith("1"), F.lit(False))


def valid_games(df: DataFrame) -> DataFrame:
    """both ratings and both rating changes present and numeric."""
    return df.dropna(subset=RATING_COLUMNS)


def reject_reason(df: DataFrame):
    """first violated constraint of the games DDL, or NULL."""
    out = None
    for c in NOT_NULL:
        cond = F.col(c).isNull()
        out = F.when(cond, F.lit(f"{c} is null")) if out is None else out.when(
            cond, F.lit(f"{c} is null"))
    for c, n in VARCHAR_LIMITS.items():
        out = out.when(F.length(c) > n, F.lit(f"{c} longer than {n}"))
    for c in SMALLINT_COLUMNS:
        out = out.when(~F.col(c).between(-32768, 32767), F.lit(f"{c} out of smallint range"))
    return out


def with_reason(df: DataFrame) -> DataFrame:
    """add ``reason`` (NULL = the row satisfies every constraint)."""
    return df.withColumn("reason", reject_reason(df))


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected-with-reason) of a frame carrying ``reason``."""
    return (checked.filter(F.col("reason").isNull()).drop("reason"),
            checked.filter(F.col("reason").isNotNull()))


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected-with-reason).  One projection, two filters."""
    return split_checked(with_reason(df))


def valid_usernames(df: DataFrame, col: str = "username") -> DataFrame:
    return df.filter(F.col(col).isNotNull() & (F.length(col) <= USERNAME_MAX))
