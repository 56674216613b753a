"""Queries that write tables and read them back: sources, sinks and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypost.operators import curation
from waypost.plans import oracle as O
from waypost.plans.catalog import register
from waypost.sources import sinks
from waypost.sources import places as S
from waypost.sources.places import places
from waypost.sources.scratch import scratch

_COLUMNS = ["naam", "provincie", "prijs", "telefoonnummer", "ai_gecheckt"]
_FILLED = ", ".join(
    f"CASE WHEN place_id % 6 = 0 THEN 'Onbekend' ELSE {c} END AS {c}" if c == "prijs" else c for c in _COLUMNS
)


def _with_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Some prices are null, which the sentinel fills."""
    return places(spark, d).select("place_id", *_COLUMNS).withColumn(
        "prijs", F.when(F.col("place_id") % 6 != 0, F.col("prijs"))
    )


@register("load_table", O.places(f"place_id, {_FILLED}"))
def load_table(spark: SparkSession, d: str) -> DataFrame:
    """Saved, and loaded from the primary table."""
    path = scratch(spark, "places")
    sinks.save(_with_nulls(spark, d), path)
    return S.load(spark, path, f"{path}-none")


@register("load_snapshot", O.places(f"place_id, {_FILLED}"))
def load_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The primary table is missing, so the CSV snapshot is read; telephone numbers keep their zeros."""
    path = scratch(spark, "places")
    sinks.save(_with_nulls(spark, d), path, f"{path}-snapshot")
    return S.load(spark, f"{path}-gone", f"{path}-snapshot", _COLUMNS)


@register("load_without_flag", O.places("place_id, naam, 'Nee' AS ai_gecheckt"))
def load_without_flag(spark: SparkSession, d: str) -> DataFrame:
    """A table without the processed flag gets it."""
    path = scratch(spark, "places")
    sinks.save(places(spark, d).select("place_id", "naam"), path)
    return S.load(spark, path, f"{path}-none")


@register(
    "save_nested",
    O.places(
        """place_id, '["' || provincie || '",null]' AS tags, '{"prijs":' || to_json(prijs) || '}' AS facts, 'Nee' AS ai_gecheckt"""
    )
)
def save_nested(spark: SparkSession, d: str) -> DataFrame:
    """K5: lists and structs are written as JSON text."""
    path = scratch(spark, "places")
    nested = places(spark, d).select(
        "place_id", F.array("provincie", F.lit(None)).alias("tags"), F.struct("prijs").alias("facts")
    )
    sinks.save(nested, path)
    return S.read_parquet(spark, path)


@register(
    "favourites_round_trip",
    O.places("place_id, naam", "WHERE naam IN (SELECT naam FROM places WHERE place_id % 7 = 1)")
)
def favourites_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Names are saved whole, read back, and select places."""
    path = scratch(spark, "favourites")
    df = places(spark, d).select("place_id", "naam")
    sinks.save_favourites(df.filter("place_id % 7 = 1"), path)
    return curation.favourites_of(df, sinks.read_favourites(spark, path)).select("place_id", "naam")


_REPORTED = (
    "'<b>' || naam", "'prijs'", "CASE WHEN place_id % 3 = 0 THEN '  ' ELSE ' 5 euro' END", "'zie ' || place_id"
)


@register(
    "reports_round_trip",
    O.places(
        f"{O.escape(_REPORTED[0])} AS naam, 'prijs' AS veld, ' 5 euro' AS correctie, {_REPORTED[3]} AS opmerking, 'nieuw' AS status, n",
        "CROSS JOIN (SELECT unnest([1, 2]) AS n) WHERE place_id % 3 <> 0"
    )
)
def reports_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Reports that say something are appended, twice here, with the name escaped; times are left out."""
    path = scratch(spark, "reports")
    names = ("naam", "veld", "correctie", "opmerking")
    rows = places(spark, d).selectExpr(
        "place_id", *[f"{sql} AS {name}_" for name, sql in zip(names, _REPORTED, strict=True)]
    ).select(*[F.col(f"{c}_").alias(c) for c in names])
    sinks.append_reports(rows, path)
    sinks.append_reports(rows, path)
    read = sinks.read_reports(spark, path).filter("timestamp is not null").groupBy(*names, "status").count()
    return read.select(*names, "status", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("n"))
