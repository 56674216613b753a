"""Oracle SQL pieces, in DuckDB's dialect, written apart from the Spark expressions they check."""

from __future__ import annotations

from waypost.functions.clean import EMPTY
from waypost.functions.normalize import OFFICIAL, PROVINCES, TWO_DIGIT_AREAS, UNKNOWN_PHONE, UNKNOWN_PROVINCE
from waypost.sources.places import GAZETTEER_SQL, PLACES_SQL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def among(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def places(select: str, tail: str = "", extra: str = "") -> str:
    return f"WITH places AS ({PLACES_SQL}){extra} SELECT {select} FROM places {tail}"


GAZETTEER = f", gazetteer AS ({GAZETTEER_SQL})"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\x{{00a0}}]+|[\\s\\x{{00a0}}]+$', '', 'g')"


def clean(c: str, fallback: str = "Onbekend") -> str:
    return f"CASE WHEN {c} IS NULL OR lower({strip(c)}) IN {among(EMPTY)} THEN {q(fallback)} ELSE {strip(c)} END"


def number(c: str) -> str:
    t = strip(f"replace({c}, ',', '.')")
    return f"CASE WHEN regexp_matches({t}, '^[+-]?(\\d+\\.?\\d*([eE][+-]?\\d+)?|\\.\\d+([eE][+-]?\\d+)?)$') THEN TRY_CAST({t} AS DOUBLE) END"


def yes(c: str) -> str:
    return f"coalesce(lower({strip(c)}) = 'ja', false)"


def says(c: str, word: str) -> str:
    return f"coalesce(contains(lower({c}), {q(word)}), false)"


def score(c: str) -> str:
    f = number(f"split_part(replace({clean(c, '')}, ',', '.'), '/', 1)")
    return f"CASE WHEN ({f}) <= 5.0 THEN round(({f}) * 2, 1) ELSE round(({f}), 1) END"


def limit(t: str) -> str:
    found = f"regexp_extract({t}, '\\d+(?:[.,]\\d+)?', 0)"
    return f"CASE WHEN regexp_matches({t}, 'geen|onbeperkt') THEN 99.0::DOUBLE WHEN {found} = '' THEN 0.0::DOUBLE ELSE TRY_CAST(replace({found}, ',', '.') AS DOUBLE) END"


def metres(c: str) -> str:
    return limit(f"lower({clean(c, '0')})")


def tons(c: str) -> str:
    return limit(f"replace(lower({clean(c, '0')}), ',', '.')")


def province(c: str) -> str:
    t = strip(c)
    whens = [f"WHEN {c} IS NULL OR lower({t}) IN {among(UNKNOWN_PROVINCE)} THEN 'Onbekend'"]
    whens += [f"WHEN lower({t}) = {q(k)} THEN {q(v)}" for k, v in PROVINCES.items()]
    whens += [f"WHEN lower({t}) IN {among(OFFICIAL)} THEN {t}"]
    whens += [f"WHEN contains(lower({t}), {q(k)}) THEN {q(v)}" for k, v in PROVINCES.items()]
    return "CASE " + " ".join(whens) + f" ELSE {t} END"


def phone(c: str) -> str:
    t = strip(c)
    raw = f"regexp_replace({t}, '[^0-9]', '', 'g')"
    d = f"(CASE WHEN {raw} LIKE '0031%' AND length({raw}) >= 12 THEN '0' || substr({raw}, 5) WHEN {raw} LIKE '31%' AND length({raw}) = 11 THEN '0' || substr({raw}, 3) ELSE {raw} END)"
    return f"""CASE WHEN {c} IS NULL OR lower({t}) IN {among(UNKNOWN_PHONE)} THEN 'Onbekend'
      WHEN length({d}) <> 10 OR {d} NOT LIKE '0%' THEN {t}
      WHEN {d} LIKE '06%' THEN '+31 6 ' || substr({d}, 3, 4) || ' ' || substr({d}, 7)
      WHEN substr({d}, 2, 2) IN {among(TWO_DIGIT_AREAS)} THEN '+31 ' || substr({d}, 2, 2) || ' ' || substr({d}, 4, 3) || ' ' || substr({d}, 7)
      ELSE '+31 ' || substr({d}, 2, 3) || ' ' || substr({d}, 5, 3) || ' ' || substr({d}, 8) END"""


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"(2 * 6371.0 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


def distance(lat: float, lon: float) -> str:
    a, b = number("latitude"), number("longitude")
    return f"CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN 9999.0 ELSE {km(str(lat), str(lon), f'({a})', f'({b})')} END"


def escape(c: str) -> str:
    out = f"({c})"
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = f"replace({out}, {q(raw)}, {q(safe)})"
    return out
