"""Normalisers of province names and telephone numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.functions.clean import UNKNOWN, stripped

# Spellings of provinces in the order in which they are tried, the
# official names, the texts that count as unknown, and two-digit area codes.
PROVINCES = {
    "fryslân": "Friesland",
    "fryslan": "Friesland",
    "frisian": "Friesland",
    "friesland": "Friesland",
    "north holland": "Noord-Holland",
    "north-holland": "Noord-Holland",
    "noord holland": "Noord-Holland",
    "noordholland": "Noord-Holland",
    "south holland": "Zuid-Holland",
    "south-holland": "Zuid-Holland",
    "zuidholland": "Zuid-Holland",
    "south holand": "Zuid-Holland",
    "north brabant": "Noord-Brabant",
    "north-brabant": "Noord-Brabant",
    "noord brabant": "Noord-Brabant",
    "noordbrabant": "Noord-Brabant",
    "nb": "Noord-Brabant",
    "groningen": "Groningen",
    "drenthe": "Drenthe",
    "overijssel": "Overijssel",
    "flevoland": "Flevoland",
    "gelderland": "Gelderland",
    "guelders": "Gelderland",
    "utrecht": "Utrecht",
    "zeeland": "Zeeland",
    "zealand": "Zeeland",
    "limburg": "Limburg",
    "sud-holland": "Zuid-Holland",
    "sud holland": "Zuid-Holland",
}
OFFICIAL = [
    "groningen", "friesland", "drenthe", "overijssel", "flevoland", "gelderland", "utrecht", "noord-holland",
    "zuid-holland", "zeeland", "noord-brabant", "limburg"
]
UNKNOWN_PROVINCE = ["onbekend", "nan", "none", "", "-", "unknown"]
UNKNOWN_PHONE = ["onbekend", "nan", "none", "", "-", "–", "unknown", "n/a"]
TWO_DIGIT_AREAS = ["20", "10", "30", "70", "40", "45", "46", "50", "55", "58", "73", "76", "77", "78", "79"]
NO_POWER_PRICE = "Nee (geen stroom)"


def province(c: Column) -> Column:
    """Exact spelling, then official name as it is, then the first spelling contained."""
    t = stripped(c)
    low = F.lower(t)
    exact = F.create_map(*[F.lit(x) for pair in PROVINCES.items() for x in pair])
    out = F.when(c.isNull() | low.isin(UNKNOWN_PROVINCE), UNKNOWN).when(
        F.try_element_at(exact, low).isNotNull(), F.try_element_at(exact, low)
    ).when(low.isin(OFFICIAL), t)
    for spelling, name in PROVINCES.items():
        out = out.when(F.contains(low, F.lit(spelling)), name)
    return out.otherwise(t)


def phone(c: Column) -> Column:
    """Dutch numbers in one international format, others as they are."""
    t = stripped(c)
    raw = F.regexp_replace(t, "[^0-9]", "")
    digits = F.when(
        F.startswith(raw, F.lit("0031")) & (F.length(raw) >= 12), F.concat(F.lit("0"), F.substring(raw, 5, 1000))
    )
    digits = digits.when(
        F.startswith(raw, F.lit("31")) & (F.length(raw) == 11), F.concat(F.lit("0"), F.substring(raw, 3, 1000))
    ).otherwise(raw)
    local = F.substring(digits, 2, 9)
    piece = lambda a, n: F.substring(local, a, n)
    national = F.when(F.startswith(local, F.lit("6")), F.concat_ws(" ", F.lit("+31 6"), piece(2, 4), piece(6, 4)))
    national = national.when(
        piece(1, 2).isin(TWO_DIGIT_AREAS), F.concat_ws(" ", F.lit("+31"), piece(1, 2), piece(3, 3), piece(6, 4))
    )
    national = national.otherwise(F.concat_ws(" ", F.lit("+31"), piece(1, 3), piece(4, 3), piece(7, 3)))
    regular = (F.length(digits) == 10) & F.startswith(digits, F.lit("0"))
    return F.when(c.isNull() | F.lower(t).isin(UNKNOWN_PHONE), UNKNOWN).when(regular, national).otherwise(t)


def postprocess(df: DataFrame) -> DataFrame:
    """Province, telephone and power price of whatever columns are there; a list ``extra`` becomes text."""
    out = {}
    if "provincie" in df.columns:
        out["provincie"] = province(F.col("provincie"))
    if "telefoonnummer" in df.columns:
        out["telefoonnummer"] = phone(F.col("telefoonnummer"))
    if "stroom" in df.columns:
        old = F.col("stroom_prijs") if "stroom_prijs" in df.columns else F.lit(None).cast("string")
        out["stroom_prijs"] = F.when(F.lower("stroom") == "nee", NO_POWER_PRICE).otherwise(old)
    if "extra" in df.columns and df.schema["extra"].dataType.typeName() == "array":
        out["extra"] = F.concat_ws(", ", "extra")
    return df.withColumns(out)
