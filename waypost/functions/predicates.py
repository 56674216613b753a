"""Row filters, as boolean columns."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from waypost.functions.clean import clean, is_yes, metres, parse_score, says, tons

# Accommodations that aren't stop-overs, thresholds, and texts that set no province filter.
NOT_A_STOPOVER = "hotel|appartement|bungalow|chalet|vakantiepark|resort|villa|studio"
LONG_M, HEAVY_T = 8.0, 3.5
NO_PROVINCE = ("null", "none", "")
NO_OPTION = ["onbekend", "", "nan"]
SHORT_TEXT, MANY_UNKNOWN = 250, 4


def any_of(conditions: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions, F.lit(True))


def in_province(text: str, regex: bool = False) -> Column:
    """literal by default; ``regex`` for the reference's reading."""
    column = F.col("provincie")
    return F.coalesce(column.rlike(f"(?i){text}"), F.lit(False)) if regex else says(column, text)


def free(c: str = "prijs") -> Column:
    """F3."""
    return says(F.col(c), "gratis")


def extracted(columns: list[str], wanted: dict) -> tuple[Column, list[str]]:
    """F1-F8: the conjunction of extracted filters and a label for each that applies."""
    found: list[tuple[str, Column]] = []
    province = wanted.get("provincie")
    if province and str(province).lower() not in NO_PROVINCE and "provincie" in columns:
        found.append((f"Provincie: {province}", in_province(str(province))))
    for key, label in (("honden_toegestaan", "Honden"), ("stroom", "Stroom")):
        if wanted.get(key) in ("Ja", "Nee") and key in columns:
            found.append((f"{label}: {wanted[key]}", says(F.col(key), wanted[key])))
    if wanted.get("is_gratis") is True and "prijs" in columns:
        found.append(("Gratis", free()))
    if wanted.get("water") == "Ja":
        found.append(
            ("Water: Ja", any_of([says(F.col(c), "ja") for c in ("waterfront", "water_tanken") if c in columns]))
        )
    for key, label in (("sanitair", "Sanitair"), ("wifi", "Wifi")):
        if wanted.get(key) == "Ja" and key in columns:
            found.append((f"{label}: Ja", says(F.col(key), "ja")))
    return all_of([c for _, c in found]), [label for label, _ in found] or ["Geen filters herkend"]


def long_vehicle() -> Column:
    """F9."""
    return metres(F.col("max_lengte")) >= LONG_M


def heavy_vehicle() -> Column:
    """F10."""
    return tons(F.col("max_gewicht")) >= HEAVY_T


def a_stopover(name: str = "naam") -> Column:
    """F12."""
    return ~F.coalesce(F.lower(F.col(name)).rlike(NOT_A_STOPOVER), F.lit(False))


def unprocessed() -> Column:
    """F14."""
    return F.coalesce(F.col("ai_gecheckt"), F.lit("")) != "Ja"


def unchanged() -> Column:
    """F15."""
    return ~F.col("changed") & (F.lower("ai_gecheckt") == "ja")


def unknowns(columns: Sequence[str]) -> Column:
    """A5: how many of the columns say unknown."""
    return F.size(F.filter(F.array(*[F.lower(F.trim(F.col(c))) for c in columns]), lambda v: v == "onbekend"))


def needs_fallback(columns: Sequence[str]) -> Column:
    """F16: too little text, or too much unknown."""
    return (F.col("total_len") < SHORT_TEXT) | (unknowns(columns) > MANY_UNKNOWN)


#: How results can be ordered; every order ends with the key.
ORDERS = ("key", "name", "free", "rating", "distance")


def order_by(choice: str = "key") -> list[Column]:
    """The columns of an order; "distance" needs afstand_km."""
    rating, name = F.desc_nulls_last(parse_score(F.col("beoordeling"))), F.lower("naam")
    first = {
        "key": [], "name": [name], "free": [F.desc(free()), name], "rating": [rating],
        "distance": [F.asc_nulls_last("afstand_km")]
    }
    return [*first[choice], F.col("place_id")]


def priced(kind: str) -> Column:
    """Free places by what their price says, or paid ones: neither free nor unknown."""
    return free() if kind == "free" else ~free() & (clean(F.col("prijs"), "") != "")


def rated(least: float) -> Column:
    return F.coalesce(parse_score(F.col("beoordeling")) >= least, F.lit(False))


def offers(columns: Sequence[str]) -> Column:
    """Places that say yes to every one of the facility columns."""
    return all_of([is_yes(F.col(c)) for c in columns])
