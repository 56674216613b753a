"""The place table: reading it from files, and deriving one from the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waypost.functions.clean import UNKNOWN

# Columns of the base table and of the enrichment contract.
BASE = [
    "naam", "latitude", "longitude", "telefoonnummer", "provincie", "honden_toegestaan", "stroom", "waterfront",
    "aantal_plekken", "prijs", "website", "ai_gecheckt", "afbeelding"
]
ENRICHED = [
    "naam", "provincie", "prijs", "honden_toegestaan", "stroom", "stroom_prijs", "afvalwater", "chemisch_toilet",
    "water_tanken", "aantal_plekken", "check_in_out", "beschrijving", "ondergrond", "toegankelijkheid", "rust",
    "sanitair", "wifi", "waterfront", "beoordeling", "samenvatting_reviews", "telefoonnummer", "roken", "feesten",
    "faciliteiten_extra", "huisregels", "loc_type", "drukte_indicator", "max_lengte", "max_gewicht",
    "remote_work_score", "voertuig_types", "tarieftype", "ai_gecheckt"
]


def place_schema(columns: list[str] | None = None) -> T.StructType:
    """All text, as the sources are; typed columns are derived, never read."""
    names = columns or list(dict.fromkeys([*BASE, *ENRICHED, "photos"]))
    return T.StructType([T.StructField("place_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in names)])


def finished(df: DataFrame) -> DataFrame:
    """S1's last steps: the processed flag where it lacks, and the sentinel for nulls in text."""
    if "ai_gecheckt" not in df.columns:
        df = df.withColumn("ai_gecheckt", F.lit("Nee"))
    return df.na.fill(UNKNOWN)


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Text columns stay text, so telephone numbers keep their zeros."""
    return finished(
        spark.read.schema(place_schema(columns))
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return finished(spark.read.parquet(path))


def load(spark: SparkSession, primary: str, fallback: str, columns: list[str] | None = None) -> DataFrame:
    """The primary table, or the CSV snapshot (of ``columns``) where that can't be read or is empty."""
    try:
        found = read_parquet(spark, primary)
        if not found.isEmpty():
            return found
    except Exception:  # noqa: BLE001  any failure of the primary source means the snapshot
        pass
    return read_csv(spark, fallback, columns)


def _choice(n: int, *values: str) -> str:
    """SQL: one of the values by place_id modulo n; the last stands for the rest."""
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE p_partkey % {n} {whens} ELSE {values[-1]} END"


def _q(*texts: str) -> list[str]:
    return ["'" + t.replace("'", "''") + "'" for t in texts]


def _coordinate(base: int, factor: int, span: int) -> str:
    m = f"({base} + (p_partkey * {factor}) % {span})"
    text = f"CAST(CAST(({m} - {m} % 1000) / 1000 AS INT) AS STRING) || '{{}}' || lpad(CAST({m} % 1000 AS STRING), 3, '0')"
    return f"CASE WHEN p_partkey % 41 = 0 THEN 'Onbekend' WHEN p_partkey % 13 = 0 THEN {text.format(',')} ELSE {text.format('.')} END"


_JA_NEE = ["'Ja'", "'Nee'", "'Onbekend'"]
#: Places derived from parts, in SQL that Spark and DuckDB read alike.
DERIVED = {
    "place_id": "p_partkey",
    "naam": _choice(8, "'Camping ' || p_name", "'Parking ' || p_name", "'Jachthaven ' || p_name", "'Hotel ' || p_name", "p_name", "'Boerderij ' || p_name", "'  ' || p_name", "'Onbekend'"),
    "provincie": _choice(12, *_q("Fryslân", "North Holland", "noord-holland", "Drenthe", "zuid holland", "Oldenburg", "Regio Utrecht", "unknown", "-", "Zeeland", " Limburg ", "Onbekend")),
    "latitude": _coordinate(50750, 7919, 2811),
    "longitude": _coordinate(3360, 104729, 3871),
    "stroom": _choice(3, *_JA_NEE),
    "honden_toegestaan": _choice(5, *_q("Ja", "Nee", "Onbekend", "ja ", "Ja, aangelijnd")),
    "water_tanken": _choice(4, *_JA_NEE),
    "waterfront": _choice(7, *_JA_NEE),
    "sanitair": _choice(6, *_JA_NEE),
    "wifi": _choice(9, *_JA_NEE),
    "afvalwater": _choice(11, *_JA_NEE),
    "prijs": _choice(5, "'Gratis'", "'gratis (max 48u)'", "'€' || CAST(p_size AS STRING)", "'Onbekend'", "'-'"),
    "beoordeling": _choice(7, *_q("4.3", "4,5/5", "8.2", "Onbekend", "goed", "9/10", "0")),
    "max_lengte": _choice(5, *_q("Geen beperking", "8m", "7,5 m", "Onbekend", "12 meter")),
    "max_gewicht": _choice(5, *_q("3.5t", "3,5 ton", "Onbekend", "Onbeperkt", "2t")),
    "telefoonnummer": _choice(5, "'06' || lpad(CAST(p_partkey AS STRING), 8, '0')", *_q("+31 20 123 4567", "0031612345678", "Onbekend", "12345")),
    "drukte_indicator": _choice(5, *_q("Snel vol in het seizoen", "Vaak plek beschikbaar", "Druk in zomer", "Onbekend", "Rustig")),
    "ai_gecheckt": _choice(3, *_q("Ja", "Nee", "ja")),
    "photos": _choice(4, *_q('["https://a/1.jpg","https://a/2.jpg"]', "[]", "Onbekend", "not json")),
}


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived place relation; columns that a query doesn't use are pruned from the scan."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        *[f"{sql} AS {name}" for name, sql in DERIVED.items()]
    )


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr(*GAZETTEER)


GAZETTEER = [
    "CAST(n_nationkey AS BIGINT) AS city_id", "CAST(50 + n_nationkey % 5 AS DOUBLE) AS lat",
    "CAST(3 + CAST(floor(n_nationkey / 5) AS BIGINT) AS DOUBLE) AS lon",
    "CASE WHEN n_nationkey % 6 = 5 THEN 'DE' ELSE 'NL' END AS cc", "n_name AS admin1"
]
PLACES_SQL = "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in DERIVED.items()) + " FROM part"
GAZETTEER_SQL = "SELECT " + ", ".join(GAZETTEER) + " FROM nation"
