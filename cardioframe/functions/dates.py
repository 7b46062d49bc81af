"""Dates of recordings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds that the camera's clock runs ahead of the Unix clock: a fixed value of its file format.
CAMERA_EPOCH = 11644444800


def unix_seconds(camera: Column) -> Column:
    return camera.cast("long") - CAMERA_EPOCH


def day(seconds: Column) -> Column:
    """The UTC day, in a session whose time zone is UTC."""
    return F.to_date(F.timestamp_seconds(seconds))


def sunday_week(d: Column) -> Column:
    """Week of the year, 00 to 53; weeks begin on Sundays and days before the first one are in week 00."""
    return F.lpad(F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("string"), 2, "0")


def year_week(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("-"), sunday_week(d))


def recording_day(file_date: Column, metadata_date: Column) -> Column:
    return F.coalesce(file_date, metadata_date)


def week_and_year(d: Column) -> Column:
    """The week before the year, with a blank between them."""
    return F.concat(sunday_week(d), F.lit(" "), F.year(d).cast("string"))


def frame_time(k: Column, interval: Column) -> Column:
    """Seconds from the start of a recording to its k-th frame."""
    return k * interval
