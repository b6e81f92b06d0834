"""Date parts and day offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names, index 0 = Sunday.
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
# Fixed value: days per month used for month offsets.
DAYS_PER_MONTH = 30.5


def weekday0(ts: Column) -> Column:
    """Day of week with 0 = Sunday (Spark's dayofweek has 1 = Sunday)."""
    return (F.dayofweek(ts) - 1).cast("int")


def day_name(dow0: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), dow0 + 1)


def minute_of_day(hour: Column, minute: Column) -> Column:
    return (hour * 60 + minute).cast("int")


def time_string(hour: Column, minute: Column) -> Column:
    return F.format_string("%02d:%02d:00", hour, minute)


def date_parts(ts: Column) -> list[Column]:
    return [weekday0(ts).alias("day"), F.hour(ts).cast("int").alias("hour"),
            F.minute(ts).cast("int").alias("minute")]


def months_since_start(days: Column) -> Column:
    return F.floor(days / F.lit(DAYS_PER_MONTH)).cast("int")


def first_int(c: Column) -> Column:
    """First run of digits in a text, as int (NULL when there is none)."""
    return F.nullif(F.regexp_extract(c, r"\d+", 0), F.lit("")).cast("int")
