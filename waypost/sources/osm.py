"""Places from saved map-data payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypost.functions.clean import PLACEHOLDER_IMAGE, UNKNOWN, non_empty
from waypost.functions.predicates import a_stopover

# The payload's shape, the search box (south, west, north, east) and the tag clauses.
PAYLOAD = "struct<elements: array<struct<type: string, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>>>"
BOX = (50.75, 3.36, 53.56, 7.23)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One JSON payload a file; a file that isn't JSON gives no element."""
    return elements(spark.read.text(path, wholetext=True), "value")


def elements(df: DataFrame, column: str, *keep: str) -> DataFrame:
    parsed = df.select(*keep, F.from_json(F.col(column), PAYLOAD).alias("payload"))
    return parsed.select(*keep, F.explode("payload.elements").alias("e"))


def _tag(name: str) -> Column:
    return non_empty(F.try_element_at(F.col("e.tags"), F.lit(name)))


def _yes(name: str) -> Column:
    return F.when(_tag(name) == "yes", "Ja").otherwise(UNKNOWN)


def in_search() -> Column:
    """The clauses that the live source evaluates remotely: tag combinations within the box."""
    kind, motorhome = F.col("e.type"), _tag("motorhome")
    site = _tag("tourism") == "caravan_site"
    parking = (_tag("amenity") == "parking") & (motorhome == "yes") & kind.isin("node", "way")
    camp = (_tag("tourism") == "camp_site") & motorhome.rlike("yes|designated")
    lat, lon = _coordinates()
    south, west, north, east = BOX
    return F.coalesce(site | parking | camp, F.lit(False)) & lat.between(south, north) & lon.between(west, east)


def _coordinates() -> tuple[Column, Column]:
    """The element's own, else its centre's; exactly zero counts as missing."""
    return tuple(F.coalesce(F.nullif(F.col(f"e.{x}"), F.lit(0.0)), F.col(f"e.center.{x}")) for x in ("lat", "lon"))


def ingest(df: DataFrame, *keep: str) -> DataFrame:
    """The base columns from exploded elements ``e``."""
    lat, lon = _coordinates()
    out = df.select(
        *keep,
        F.coalesce(_tag("name"), F.trim(F.concat(F.lit("Camperplaats "), F.coalesce(_tag("addr:city"), F.lit(""))))).alias("naam"),
        lat.alias("latitude"),
        lon.alias("longitude"),
        F.translate(F.coalesce(_tag("phone"), _tag("contact:phone"), F.lit("")), " -", "").alias("telefoonnummer"),
        F.lit(UNKNOWN).alias("provincie"),
        _yes("dog").alias("honden_toegestaan"),
        _yes("power_supply").alias("stroom"),
        _yes("water_point").alias("waterfront"),
        F.coalesce(_tag("capacity"), F.lit(UNKNOWN)).alias("aantal_plekken"),
        F.coalesce(_tag("charge"), F.when(_tag("fee") == "no", "Gratis"), F.lit(UNKNOWN)).alias("prijs"),
        F.coalesce(_tag("website"), _tag("contact:website"), F.lit("")).alias("website"),
        F.lit("Nee").alias("ai_gecheckt"),
        F.lit(PLACEHOLDER_IMAGE).alias("afbeelding"),
    )
    return out.filter(a_stopover()).filter(
        F.col("latitude").isNotNull()
        & (F.col("latitude") != 0)
        & F.col("longitude").isNotNull()
        & (F.col("longitude") != 0)
    )
