"""Scalar tables: literal inputs and what they must give."""

import pytest
from pyspark.sql import functions as F
from waypost.functions import clean as C
from waypost.functions import display as D
from waypost.functions import normalize as N
from waypost.functions.geo import haversine
from waypost.operators.search import first_json

CASES = {
    "clean": (lambda c: C.clean(c), [(None, "Onbekend"), (" x ", "x"), ("N/A", "Onbekend"), ("–", "Onbekend"), ("0", "0"), (" y\t", "y"), ("[]", "Onbekend")]),
    "safe_float": (lambda c: C.safe_float(c, -1.0), [("4,5", 4.5), (" 7 ", 7.0), ("1.234,5", -1.0), ("abc", -1.0), ("1.5d", -1.0), (None, -1.0), ("1e3", 1000.0), (".5", 0.5)]),
    "is_yes": (C.is_yes, [("Ja", True), (" JA ", True), ("Ja, tegen betaling", False), (None, False)]),
    "format_score": (C.format_score, [("4.2", "4.2/5"), ("4/5", "4/5"), ("goed", "goed"), ("-", "")]),
    "parse_score": (C.parse_score, [("4.3", 8.6), ("4,5/5", 9.0), ("8.2", 8.2), ("4/10", 8.0), ("9/10", 9.0), ("0", 0.0), ("goed", None)]),
    "visible_score": (lambda c: C.visible_score(C.parse_score(c)), [("0", None), ("4", 8.0)]),
    "metres": (C.metres, [("8m", 8.0), ("7,5 m", 7.5), ("Geen beperking", 99.0), ("Onbekend", 0.0), ("max 12 meter", 12.0), (None, 0.0)]),
    "tons": (C.tons, [("3,5 ton", 3.5), ("Onbeperkt", 99.0), ("Onbekend", 0.0), ("3.5t", 3.5)]),
    "province": (N.province, [("Fryslân", "Friesland"), ("noord-holland", "noord-holland"), ("zuid holland", "zuid holland"), ("Oldenburg", "Noord-Brabant"), ("Regio Utrecht", "Utrecht"), ("Provincie Noord-Holland", "Provincie Noord-Holland"), ("unknown", "Onbekend"), (None, "Onbekend"), ("", "Onbekend")]),
    "phone": (N.phone, [("0612345678", "+31 6 1234 5678"), ("+31 20 123 4567", "+31 20 123 4567"), ("0031612345678", "+31 6 1234 5678"), ("0151234567", "+31 151 234 567"), ("12345", "12345"), ("n/a", "Onbekend"), (None, "Onbekend"), ("+31 6 1234 5678", "+31 6 1234 5678")]),
    "crowding": (D.crowding, [("Snel vol in het seizoen", "vol"), ("Druk in zomer", "druk"), ("Vaak plek beschikbaar", "plek"), ("Rustig", "Rustig"), ("Onbekend", None)]),
    "price": (D.price_class, [("Gratis", "gratis"), ("gratis (48u)", "betaald"), ("-", "onbekend")]),
    "map_price": (D.map_price, [("gratis (48u)", "Gratis"), (" 5 ", "5"), ("Onbekend", "?"), ("", "?")]),
    "remote": (D.remote_class, [("Uitstekend", "good"), ("matig", "poor"), ("wisselend", "info"), ("-", None)]),
    "escape": (C.escape_html, [("<a href=\"x\">'&</a>", "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&lt;/a&gt;"), (None, "None")]),
    "truncate": (lambda c: C.truncate(c, 10), [("short", "short"), ("hello big world", "hello big…"), ("abcdefghijklm", "abcdefghij…")]),
    "website": (C.website, [("http://a", "http://a"), ("a.nl", "https://a.nl")]),
    "json": (first_json, [('```json\n{"a":1}\n```', '{"a":1}'), ('x [{"a":1},{"b":2}] y', '[{"a":1},{"b":2}]'), ("[1,2]", "[1,2]"), ("⚠️ {}", None), ("niets", None), (None, None)]),
    "json_strict": (lambda c: first_json(c, strict_order=True), [('[{"a":1},{"b":2}]', None), ('[{"a":1}]', '{"a":1}'), ("[1]", "[1]")]),
    "label": (lambda c: C.score_label(c.cast("double")), [("9", "Uitzonderlijk"), ("8.5", "Geweldig"), ("8", "Heel goed"), ("7.5", "Goed"), ("7", "Prima"), ("6.9", "Redelijk")]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_table(name, spark):
    function, cases = CASES[name]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v string")
    got = [r[0] for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").select("o").collect()]
    assert got == [want for _, want in cases]


def test_haversine_properties(spark):
    points = spark.createDataFrame(
        [(52.3, 5.3, 51.0, 4.0), (0.0, 0.0, 0.0, 180.0), (10.0, 10.0, 10.0, 10.0), (-90.0, 0.0, 90.0, 0.0)],
        "a double, b double, c double, d double"
    )
    there, back = haversine(
        F.col("a"), F.col("b"), F.col("c"), F.col("d")
    ), haversine(F.col("c"), F.col("d"), F.col("a"), F.col("b"))
    for r in points.select(there.alias("x"), back.alias("y")).collect():
        assert r.x == pytest.approx(r.y) and 0 <= r.x <= 6371.0 * 3.14159266


def test_distances_equal_sql_to_the_last_bit(spark, duck):
    """Places that are equally far but for rounding are ranked by these bits."""
    from waypost.operators import geo, search
    from waypost.plans import oracle as O

    spots = [(f"{50.75 + i * 7919 % 2811 / 1000:.3f}", f"{3.36 + i * 104729 % 3871 / 1000:.3f}") for i in range(6000)]
    spots += [("52.3", f"{5.3 + i / 1000:.3f}") for i in range(-900, 900)] + [("Onbekend", "5.0")]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(spots)], "place_id long, latitude string, longitude string")
    duck.register("spots_", rows.toPandas())
    km = O.distance(52.3, 5.3)
    want = duck.execute(f"SELECT place_id, {km} AS km, row_number() OVER (ORDER BY {km}, place_id) AS rank FROM spots_").fetchall()
    duck.unregister("spots_")
    ranked = search.ordered(geo.add_distances(rows, 52.3, 5.3), "distance")
    assert sorted((r.place_id, r.afstand_km, r.rank) for r in ranked.collect()) == sorted(want)
    odd = spark.createDataFrame([(1, None, "5"), (2, "nan", "5"), (3, "91", "inf")], "place_id long, latitude string, longitude string")
    got = {r.place_id: r.afstand_km for r in geo.add_distances(odd, 52.3, 5.3).collect()}
    assert got[1] == got[3] == 9999.0 and got[2] != got[2]
