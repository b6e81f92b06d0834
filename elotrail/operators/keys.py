"""Dense surrogate keys for players, and name -> key encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import cumulative_before


def name_appearances(records: DataFrame, order_cols=("file", "block", "pos")) -> DataFrame:
    """(username, ord...) of every White and Black tag, White first in a record."""
    s = F.explode(F.array(
        F.struct(F.col("White").alias("username"), F.lit(0).alias("slot")),
        F.struct(F.col("Black").alias("username"), F.lit(1).alias("slot"))))
    return (records.select(*order_cols, s.alias("n"))
            .select("n.username", *order_cols, "n.slot")
            .filter(F.col("username").isNotNull()))


def assign_ids(appearances: DataFrame, existing: DataFrame | None,
               order_cols=("file", "block", "pos", "slot")) -> DataFrame:
    """Ids for names not in ``existing``: max(existing id) + 1, + 2, ... in
    order of first appearance.  Returns only the new (id, username) rows.

    first appearance = the least order per name (partial aggregation, a hot
    name is one row per task; a single number as order aggregates by hash, a
    struct by sorting); the dense numbering is a range-sliced running count (no
    single-task window)."""
    order = F.struct(*order_cols) if len(order_cols) > 1 else F.col(order_cols[0])
    first = appearances.groupBy("username").agg(F.min(order).alias("o"))
    if existing is not None:
        first = first.join(existing.select("username"), "username", "left_anti")
        base = F.coalesce(existing.select(F.max("id")).scalar(), F.lit(0))
    else:
        base = F.lit(0)
    flat = first.select("username", *[
        (F.col(f"o.{c}") if len(order_cols) > 1 else F.col("o")).alias(c) for c in order_cols])
    ranked = cumulative_before(flat, [], list(order_cols))
    return ranked.select((base + F.col("_before") + 1).cast("int").alias("id"), "username")


def encode_players(games: DataFrame, users: DataFrame) -> DataFrame:
    """Replace ``white_name`` / ``black_name`` by user ids.

    Left joins: a name without an id (missing tag, name too long for the
    dimension) leaves a NULL id, which the constraint check (F3) turns into
    a reject with a reason instead of a silently lost game.  No hint: the
    session's broadcast limit on measured bytes decides, else the join is
    shuffled and AQE splits a hot name."""
    dim = users.select("id", "username")
    w = dim.select(F.col("id").alias("white"), F.col("username").alias("white_name"))
    b = dim.select(F.col("id").alias("black"), F.col("username").alias("black_name"))
    return games.join(w, "white_name", "left").join(b, "black_name", "left")
