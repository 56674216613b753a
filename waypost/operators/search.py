"""Search: a cascade over names and provinces, filters from text, JSON out of noisy text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.functions.clean import says, stripped
from waypost.functions.normalize import OFFICIAL
from waypost.functions.predicates import all_of, extracted, heavy_vehicle, long_vehicle, offers, order_by, priced, rated
from waypost.operators.batching import ranked
from waypost.operators.curation import favourites_of

FILTER = "struct<provincie: string, honden_toegestaan: string, is_gratis: boolean, stroom: string, water: string, sanitair: string, wifi: string>"


def cascade(df: DataFrame, query: str, regex: bool = False) -> DataFrame:
    """Q1: rows whose name matches; where none does, those whose province does; else all, with use_ai.

    The best stage is one aggregate row, so the table isn't counted twice and
    no row leaves its partition.
    """
    q = (query or "").strip().lower()
    if not q:
        return df.withColumn("use_ai", F.lit(False))
    match = (lambda c: F.coalesce(F.lower(F.col(c)).rlike(q), F.lit(False))) if regex else (lambda c: says(F.col(c), q))
    staged = df.withColumn("stage_", F.when(match("naam"), 1).when(match("provincie"), 2))
    best = staged.agg(F.min("stage_").alias("best_"))
    joined = staged.crossJoin(F.broadcast(best))  # one row
    return joined.filter(
        F.col("best_").isNull() | (F.col("stage_") == F.col("best_"))
    ).withColumn("use_ai", F.col("best_").isNull()).drop("stage_", "best_")


def first_json(text: Column, strict_order: bool = False) -> Column:
    """Q4: the JSON object or array in noisy or fenced text, as text; null where none parses.

    An array is looked for where the first bracket comes before the first
    brace. ``strict_order`` always takes the object and fails where that doesn't
    parse, which loses arrays of several objects.
    """
    fenced = F.startswith(stripped(text), F.lit("```"))
    inner = F.when(
        fenced, F.regexp_replace(F.regexp_replace(stripped(text), r"^[^\n]*\n", ""), r"\n[^\n]*$", "")
    ).otherwise(text)
    whole = F.regexp_extract(inner, r"(?s)\{.*\}", 0)
    listed = F.regexp_extract(inner, r"(?s)\[.*\]", 0)
    # a parser stops after the first value; within brackets what follows it shows
    parse = lambda c: F.when(
        F.try_parse_json(c).isNotNull() & (F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1), c
    )
    brace, bracket = F.instr(inner, "{"), F.instr(inner, "[")
    list_first = (bracket > 0) & ((brace == 0) | (bracket < brace))
    either = F.coalesce(parse(whole), parse(listed))
    object_first = F.when(whole != "", parse(whole)).otherwise(parse(listed))
    found = object_first if strict_order else F.when(
        list_first, F.coalesce(parse(listed), parse(whole))
    ).otherwise(either)
    return F.when(text.isNotNull() & ~F.startswith(text, F.lit("⚠️")), found)


def geocode_query(c: Column) -> Column:
    """S10's text: the country is added unless it is named."""
    return F.when(F.contains(F.lower(c), F.lit("nederland")), c).otherwise(F.concat(c, F.lit(", Nederland")))


def keyword_extractor(query: str) -> dict:
    """An offline stand-in for Q2's model: plain keywords only."""
    q = query.lower()
    out: dict = {}
    if "gratis" in q:
        out["is_gratis"] = True
    for word, key in (
        ("hond", "honden_toegestaan"), ("stroom", "stroom"), ("water", "water"), ("sanitair", "sanitair"),
        ("wifi", "wifi")
    ):
        if word in q:
            out[key] = "Ja"
    for name in OFFICIAL:
        if name in q:
            out["provincie"] = name
    return out


def natural(
    df: DataFrame, query: str, extractor: Callable[[str], dict] = keyword_extractor
) -> tuple[DataFrame, list[str]]:
    """F8, Q2: filter by what ``extractor`` finds in the query; the labels say what applied."""
    if not (query or "").strip():
        return df, []
    condition, labels = extracted(df.columns, extractor(query) or {})
    return df.filter(condition), labels


def shortlist(
    df: DataFrame,
    *,
    text: str = "",
    provinces: Sequence[str] = (),
    price: str | None = None,
    least_score: float = 0.0,
    facilities: Sequence[str] = (),
    vehicles: Sequence[str] = (),
    favourites: DataFrame | None = None,
) -> DataFrame:
    """The places that fit all of what is asked; what isn't asked for doesn't filter.

    ``price`` is "free" or "paid", ``facilities`` are columns that must say yes,
    ``vehicles`` may hold "long" and "heavy", ``favourites`` is a table of
    names. How these apply is this library's reading.
    """
    tests = [says(F.col("naam"), text.strip())] if text.strip() else []
    tests += [F.col("provincie").isin(list(provinces))] if provinces else []
    tests += [priced(price)] if price else []
    tests += [rated(least_score)] if least_score > 0 else []
    tests += [offers(facilities)] if facilities else []
    tests += [{"long": long_vehicle, "heavy": heavy_vehicle}[kind]() for kind in vehicles]
    fitting = df.filter(all_of(tests)) if tests else df
    return fitting if favourites is None else favourites_of(fitting, favourites)


def ordered(df: DataFrame, choice: str = "key") -> DataFrame:
    """All rows with their rank in one of the orders."""
    return ranked(df, *order_by(choice))
