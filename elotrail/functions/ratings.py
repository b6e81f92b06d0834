"""Rating brackets, starting bands, half-even rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bracket width and the open-ended outer brackets
# ('elo < 600' ... '2800 <= elo'), 13 labels in all.
BRACKET_WIDTH = 200
BRACKET_LOW = 600
BRACKET_HIGH = 2800
# Starting bands '800 - 999' ... '2200 - 2399'.
BAND_WIDTH = 200
BAND_LOW = 800
BAND_HIGH = 2200


def bracket_lower(elo: Column) -> Column:
    """Numeric sort key of the bracket: 400 for 'elo < 600', else its lower bound."""
    lower = F.floor(elo / BRACKET_WIDTH) * BRACKET_WIDTH
    return F.least(F.greatest(lower, F.lit(BRACKET_LOW - BRACKET_WIDTH)),
                   F.lit(BRACKET_HIGH)).cast("int")


def bracket_label(elo: Column) -> Column:
    lower = bracket_lower(elo)
    return (F.when(elo.isNull(), F.lit(None).cast("string"))
            .when(lower < BRACKET_LOW, F.lit(f"elo < {BRACKET_LOW}"))
            .when(lower >= BRACKET_HIGH, F.lit(f"{BRACKET_HIGH} <= elo"))
            .otherwise(F.format_string("%d <= elo < %d", lower, lower + BRACKET_WIDTH)))


def start_band(start: Column) -> Column:
    """Band label of a starting rating, half-open [l, l+200); NULL outside 800-2399."""
    lower = (F.floor(start / BAND_WIDTH) * BAND_WIDTH).cast("int")
    return F.when(lower.between(BAND_LOW, BAND_HIGH),
                  F.format_string("%d - %d", lower, lower + BAND_WIDTH - 1))


def band_lower(band: Column) -> Column:
    return F.substring_index(band, " ", 1).cast("int")


def bround_gain(x: Column, digits: int = -2) -> Column:
    """Half-even rounding (50 -> 0, 150 -> 200), as Python's round()."""
    return F.bround(x, digits)
