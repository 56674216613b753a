"""Classes and labels that places are shown by, as data columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waypost.functions.clean import PLACEHOLDER_IMAGE, UNKNOWN, clean, escape_html, is_yes, says

# Fixed values: (column, label) of chips, badges, the facility grid and house rules.
CHIPS = [
    ("stroom", "Stroom"), ("wifi", "Wifi"), ("honden_toegestaan", "Honden ok"), ("water_tanken", "Water"),
    ("sanitair", "Sanitair"), ("afvalwater", "Afval")
]
BADGES = [
    ("stroom", "Stroom"), ("honden_toegestaan", "Honden"), ("wifi", "Wifi"), ("water_tanken", "Water"),
    ("waterfront", "Waterfront"), ("sanitair", "Sanitair")
]
GRID = [
    ("stroom", "Stroom"), ("stroom_prijs", "Stroomprijs"), ("wifi", "Wifi"), ("honden_toegestaan", "Honden toegestaan"),
    ("sanitair", "Sanitair"), ("water_tanken", "Water tanken"), ("afvalwater", "Afvalwater dump"),
    ("chemisch_toilet", "Chemisch toilet"), ("toegankelijkheid", "Toegankelijk"), ("waterfront", "Waterfront")
]
RULES = [("honden_toegestaan", "Honden"), ("roken", "Roken"), ("feesten", "Feesten"), ("stilteplicht", "Stilteplicht")]
FACTS = [
    ("prijs", "Prijs"), ("aantal_plekken", "Aantal plekken"), ("ondergrond", "Ondergrond"), ("rust", "Rust"),
    ("check_in_out", "Check-in/out"), ("toegankelijkheid", "Toegankelijk"), ("telefoonnummer", "Telefoon")
]
TEXTS = [
    ("beschrijving", "Geen beschrijving beschikbaar."), ("faciliteiten_extra", ""),
    ("samenvatting_reviews", "Nog geen reviews beschikbaar."), ("reviews_tekst", "")
]
DETAILS = [
    ("max_lengte", "Max voertuiglengte"), ("max_gewicht", "Max gewicht"), ("drukte_indicator", "Drukte-indicator"),
    ("remote_work_score", "4G/5G kwaliteit"), ("voertuig_types", "Voertuigtypes"), ("tarieftype", "Tarieftype")
]


def price_class(c: Column) -> Column:
    """P1."""
    p = clean(c, "")
    return F.when(F.lower(p) == "gratis", "gratis").when(p == "", "onbekend").otherwise("betaald")


def map_price(c: Column) -> Column:
    """P2."""
    p = F.trim(c.cast("string"))
    return F.when(says(p, "gratis"), "Gratis").when((p != "") & (F.lower(p) != "onbekend"), p).otherwise("?")


def crowding(c: Column) -> Column:
    """Vol, druk, plek, the text itself, or null when unknown."""
    d = clean(c, "")
    low = F.lower(d)
    return F.when(d == "", None).when(F.contains(low, F.lit("vol")), "vol").when(
        F.contains(low, F.lit("druk")), "druk"
    ).when(low.rlike("plek|vrij|ruim"), "plek").otherwise(d)


def _labels(pairs: list[tuple[str, str]], *more: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(is_yes(F.col(c)), label) for c, label in pairs], *more)), ", ")


def chips() -> Column:
    """What a place has, and its length limit."""
    limit = clean(F.col("max_lengte"), "")
    return _labels(CHIPS, F.when(limit != "", F.concat(F.lit("max "), limit)))


def badges() -> Column:
    """P5."""
    return _labels(BADGES)


def state(c: Column) -> Column:
    """Ja, nee or the text."""
    v = clean(c)
    return F.when(F.lower(v).isin("ja", "nee"), F.lower(v)).otherwise(v)


def grid(pairs: list[tuple[str, str]], columns: list[str]) -> Column:
    """One "label=state" for each; a column that isn't there is unknown."""
    return F.concat_ws(
        "; ", *[F.concat(F.lit(f"{label}="), state(F.col(c)) if c in columns else F.lit(UNKNOWN)) for c, label in pairs]
    )


def details(columns: list[str]) -> Column:
    """An array of (section, label, value) for all detail tables; a column that isn't there is unknown."""
    own = lambda c, fallback=UNKNOWN: clean(F.col(c), fallback) if c in columns else F.lit(fallback)
    rows = [
        (section, label, state(F.col(c)) if section in ("facilities", "rules") and c in columns else own(c)) for section,
        pairs in (("facts", FACTS), ("facilities", GRID), ("vehicle", DETAILS), ("rules", RULES)) for c, label in pairs
    ]
    rows += [("texts", c, own(c, fallback)) for c, fallback in TEXTS]
    return F.array(
        *[F.struct(F.lit(s).alias("section"), F.lit(label).alias("label"), v.alias("value")) for s, label, v in rows]
    )


def popup() -> dict[str, Column]:
    """What a place's map marker shows."""
    price = clean(F.col("prijs"), "?")
    shown = {
        "naam": escape_html(clean(F.col("naam"))), "provincie": escape_html(clean(F.col("provincie"), "")),
        "honden": is_yes(F.col("honden_toegestaan")), "stroom": is_yes(F.col("stroom"))
    }
    return shown | {"prijs": escape_html(price), "free": F.contains(F.lower(price), F.lit("gratis"))}


def remote_class(c: Column) -> Column:
    """P8."""
    v = F.lower(clean(c, ""))
    return F.when(v == "", None).when(
        v.rlike("uitstekend|goed"), "good"
    ).when(v.rlike("matig|slecht"), "poor").otherwise("info")


def first_of(*columns: Column) -> Column:
    """The first that isn't null or empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def photo(photos: Column, image: Column) -> Column:
    """The first of a JSON list of photos, else the image, else a placeholder."""
    usable = F.when(~photos.isin("", "nan", "Onbekend", "[]"), F.get_json_object(photos, "$[0]"))
    return F.coalesce(usable, F.nullif(clean(image, ""), F.lit("")), F.lit(PLACEHOLDER_IMAGE))


def more_photos(photos: Column) -> tuple[Column, Column]:
    """The second and third photo, and how many there are."""
    listed = F.coalesce(F.from_json(photos, "array<string>"), F.array().cast("array<string>"))
    return F.concat_ws(", ", F.slice(listed, 2, 2)), F.size(listed).cast("long")


def review_block(vibe: Column, plus: Column, minus: Column, summary: Column) -> Column:
    """P10: vibe, plus and minus where the first or second says something, else the old summary."""
    v, p, m = clean(vibe, ""), clean(plus, ""), clean(minus, "")
    parts = F.concat_ws(
        " | ", F.nullif(v, F.lit("")), F.when(p != "", F.concat(F.lit("+ "), p)),
        F.when(m != "", F.concat(F.lit("- "), m))
    )
    return F.when((v != "") | (p != ""), parts).otherwise(clean(summary, ""))


def thousands(n: Column) -> Column:
    """A count with separators."""
    return F.format_number(n, 0)


def no_results(query: Column) -> Column:
    """What an empty result says; the query is escaped."""
    return F.concat(F.lit("Geen resultaten voor “"), escape_html(query), F.lit("”"))
