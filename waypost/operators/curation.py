"""Favourites as sets of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def favourites_of(places: DataFrame, names: DataFrame) -> DataFrame:
    """J8, F20."""
    return places.join(names.select("naam").distinct(), "naam", "left_semi")


def others(places: DataFrame, names: DataFrame) -> DataFrame:
    return places.join(names.select("naam").distinct(), "naam", "left_anti")


def toggled(events: DataFrame) -> DataFrame:
    """Names that were toggled an odd number of times, from (user, naam) events."""
    return events.groupBy("user_id", "naam").agg(
        F.count("*").alias("toggles")
    ).filter("toggles % 2 = 1").select("user_id", "naam")
