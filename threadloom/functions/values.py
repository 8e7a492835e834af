"""Ids, times, hash order and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_id(col: Column) -> Column:
    """Text or number to BIGINT; "12", " 12 " and "12.0" agree, anything else is NULL.

    Numbers are read as decimals, never in floating point, so large ids stay exact and "12.9" is no id.
    """
    number = F.trim(col.cast("string")).try_cast("decimal(38,10)")
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def parse_post_time(col: Column) -> Column:
    """"Tue Oct 31 22:10:47 +0000 2017" or ISO text to a timestamp, bad text to NULL."""
    post_style = F.try_to_timestamp(F.substring(col, 5, 26), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return F.coalesce(post_style, col.try_cast("timestamp"))


def order_key(time: Column, post_id: Column) -> Column:
    """Sort key of a post in its thread: by time, missing times last, ties by id."""
    return F.struct(
        time.isNull().alias("untimed"),
        F.coalesce(time, F.timestamp_seconds(F.lit(0))).alias("at"),
        post_id.alias("id"),
    )


def hash_order(id_col: Column, seed: int) -> Column:
    """A reproducible pseudo-random order: the same in any partitioning and any engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), id_col.cast("string")))


def half_even(value: Column | str, digits: int) -> Column:
    """Rounding as everywhere in this library: a tie goes to the even digit."""
    return F.bround(value, digits)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole > 0, half_even(part * F.lit(100.0) / whole, digits)).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where undefined."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
