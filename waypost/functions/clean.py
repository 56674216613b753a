"""Cleaning and conversion of dirty text values, Column to Column.

Values are text with an in-band sentinel for "unknown" at the edges; what these
functions return as numbers has real nulls. Survey ids stand in the docstrings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sentinel and the texts that count as empty.
UNKNOWN = "Onbekend"
EMPTY = ["nan", "none", "", "onbekend", "unknown", "n/a", "null", "-", "–", "[]", "nvt", "n.v.t.", "?"]
PLACEHOLDER_IMAGE = "https://images.unsplash.com/photo-1523987355523-c7b5b0dd90a7?w=500&q=80&auto=format"
UNLIMITED, NOTHING = 99.0, 0.0

_EDGES = r"^[\s ]+|[\s ]+$"
#: What counts as a number's text; guards against casts that accept more.
_NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|nan|NaN|inf|Infinity)$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), _EDGES, "")


def clean(c: Column, fallback: str = UNKNOWN) -> Column:
    """The stripped text, or ``fallback`` for null and whatever counts as empty."""
    t = stripped(c)
    return F.when(c.isNull() | F.lower(t).isin(EMPTY), F.lit(fallback)).otherwise(t)


def escape_html(c: Column) -> Column:
    """The five characters that mark-up needs escaped; null gives the text None."""
    out = F.coalesce(c.cast("string"), F.lit("None"))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def number(c: Column) -> Column:
    """A number from text with a dot or comma as decimal mark; null where it isn't one."""
    t = stripped(F.replace(c.cast("string"), F.lit(","), F.lit(".")))
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def safe_float(c: Column, default: float = 0.0) -> Column:
    """C3."""
    return F.coalesce(number(c), F.lit(float(default)))


def is_yes(c: Column) -> Column:
    """C4: equality with "ja", ignoring case and edges."""
    return F.coalesce(F.lower(stripped(c)) == "ja", F.lit(False))


def says(c: Column, word: str) -> Column:
    """F2-F7's looser test: the text contains ``word``, ignoring case."""
    return F.coalesce(F.contains(F.lower(c.cast("string")), F.lit(word.lower())), F.lit(False))


def format_score(c: Column) -> Column:
    """C5."""
    t = clean(c, "")
    head = F.element_at(F.split(t, "/"), 1)
    return F.when(t == "", "").when(number(head).isNull(), t).when(
        F.contains(t, F.lit("/")), t
    ).otherwise(F.concat(t, F.lit("/5")))


def truncate(c: Column, limit: int = 120) -> Column:
    """Cut at the last space within ``limit`` characters and closed by an ellipsis."""
    t = c.cast("string")
    head = F.regexp_replace(F.substring(t, 1, limit), r"(?s) [^ ]*$", "")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(head, F.lit("…")))


def parse_score(c: Column) -> Column:
    """A score out of ten; values up to 5 count as out of five."""
    f = number(F.element_at(F.split(F.replace(clean(c, ""), F.lit(","), F.lit(".")), "/"), 1))
    return F.when(f <= 5.0, F.round(f * 2, 1)).otherwise(F.round(f, 1))


def score_label(score: Column) -> Column:
    """C8."""
    return F.when(
        score >= 9, "Uitzonderlijk"
    ).when(
        score >= 8.5, "Geweldig"
    ).when(score >= 8, "Heel goed").when(score >= 7.5, "Goed").when(score >= 7, "Prima").otherwise("Redelijk")


def visible_score(score: Column) -> Column:
    """Null for no score and for zero."""
    return F.when(score.isNotNull() & (score != 0), score)


def score_source(review_score: Column, rating: Column) -> Column:
    """The review score wins whenever it isn't empty, even as "unknown"."""
    return F.coalesce(F.when(review_score != "", review_score), rating)


def _limit(t: Column) -> Column:
    found = F.regexp_extract(t, r"\d+(?:[.,]\d+)?", 0)
    value = F.replace(found, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(t.rlike("geen|onbeperkt"), F.lit(UNLIMITED)).otherwise(
        F.coalesce(F.when(found != "", value), F.lit(NOTHING))
    )


def metres(c: Column) -> Column:
    """C11: a vehicle length; no limit is 99, no number is 0."""
    return _limit(F.lower(clean(c, "0")))


def tons(c: Column) -> Column:
    """A vehicle weight, as C11."""
    return _limit(F.replace(F.lower(clean(c, "0")), F.lit(","), F.lit(".")))


def route_url(lat: Column, lon: Column) -> Column:
    """C21."""
    return F.concat(
        F.lit("https://www.google.com/maps/dir/?api=1&destination="), lat.cast("string"), F.lit(","), lon.cast("string")
    )


def website(c: Column) -> Column:
    """C20."""
    return F.when(F.startswith(c, F.lit("http")), c).otherwise(F.concat(F.lit("https://"), c))


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))
