"""Raw PGN tag values -> compact typed codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event substrings (checked case-insensitively, in this order)
# and the one-letter code each maps to; anything else is '?'.
EVENT_SUBSTRINGS = [("bullet", "b"), ("blitz", "B"), ("standard", "R"), ("rapid", "R"),
                    ("classical", "c"), ("correspondence", "C")]
# Result tag -> code; anything else is '?'.
RESULT_CODES = {"1/2-1/2": "D", "1-0": "W", "0-1": "B"}
# Termination tag -> code; anything else is '?'.
TERMINATION_CODES = {"Normal": "N", "Time forfeit": "F", "Abandoned": "A"}
# Fixed value: seconds an increment counts for (40 moves).
INCREMENT_MOVES = 40


def _lookup(c: Column, table: dict[str, str]) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise("?")


def event_code(c: Column) -> Column:
    lc = F.lower(c)
    out = None
    for sub, code in EVENT_SUBSTRINGS:
        cond = lc.contains(sub)
        out = F.when(cond, code) if out is None else out.when(cond, code)
    return out.otherwise("?")


def result_code(c: Column) -> Column:
    return _lookup(c, RESULT_CODES)


def termination_code(c: Column) -> Column:
    return _lookup(c, TERMINATION_CODES)


def time_control(c: Column) -> Column:
    """``base+inc`` -> base + 40 * inc seconds; anything unparsable -> 0."""
    parts = F.split(c, r"\+", 3)
    base = F.try_element_at(parts, F.lit(1)).try_cast("int")
    inc = F.try_element_at(parts, F.lit(2)).try_cast("int")
    val = F.when(F.size(parts) == 2, base + F.lit(INCREMENT_MOVES) * inc)
    return F.coalesce(val, F.lit(0)).cast("int")


def rating_parse(c: Column) -> Column:
    """Rating or rating diff -> int; '?' anywhere (or junk) -> NULL; '+5' -> 5."""
    return F.when(~c.contains("?"), c.try_cast("int"))


def site_id(c: Column) -> Column:
    """Game id: everything after ``org/`` in the Site URL (NULL if absent)."""
    return F.nullif(F.regexp_extract(c, r"org/(.*)", 1), F.lit(""))


def game_timestamp(date: Column, time: Column) -> Column:
    """UTCDate ``yyyy.MM.dd`` + UTCTime ``HH:mm:ss`` -> timestamp_ntz (NULL if bad).

    Never by way of a zoned timestamp, so the session's zone and its
    daylight-saving gaps do not matter."""
    both = F.concat_ws(" ", date, time)
    iso = F.translate(both, ".", "-").try_cast("timestamp_ntz")
    return F.when(both.rlike(r"^\d{4}\.\d{2}\.\d{2} \d{2}:\d{2}:\d{2}$"), iso)


def analyzed_flag(moves: Column) -> Column:
    return F.coalesce(moves.contains("eval"), F.lit(False))
