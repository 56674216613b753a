"""Sources, sinks, merges, search and the stream."""

import json

import pytest
from pyspark.sql import functions as F
from tests.conftest import SF
from waypost.functions import predicates as P
from waypost.operators import batching, curation, enrich, geo, quality, search
from waypost.plans import catalog
from waypost.sources import osm, sinks
from waypost.sources import places as S


def test_save_and_load(spark, tmp_path):
    df = S.places(spark, SF).withColumn("tags", F.array(F.lit("a"), F.lit(None)))
    sinks.save(df, f"{tmp_path}/table", f"{tmp_path}/snapshot")
    assert S.load(spark, f"{tmp_path}/table", f"{tmp_path}/snapshot").count() == df.count()
    columns = [c for c in df.columns if c != "place_id"]
    back = S.load(spark, f"{tmp_path}/missing", f"{tmp_path}/snapshot", columns)
    assert back.filter("telefoonnummer like '06%'").count() == df.filter("telefoonnummer like '06%'").count() > 0
    assert {r.tags for r in back.select("tags").distinct().collect()} == {'["a",null]'}
    assert back.select("photos").exceptAll(df.select("photos")).count() == 0


def test_loading_falls_back_when_the_table_is_empty(spark, tmp_path):
    df = S.places(spark, SF).select("place_id", "naam")
    df.limit(0).write.parquet(f"{tmp_path}/empty")
    df.selectExpr(
        "place_id", "naam", *[f"'' AS {c}" for c in S.place_schema().names[2:]]
    ).write.option("header", True).csv(f"{tmp_path}/csv")
    assert S.load(spark, f"{tmp_path}/empty", f"{tmp_path}/csv").count() == df.count()


def test_processed_flag_is_added(spark):
    out = S.finished(spark.createDataFrame([("a", None)], "naam string, prijs string")).first()
    assert out.ai_gecheckt == "Nee" and out.prijs == "Onbekend"


def test_reports_and_favourites(spark, tmp_path):
    rows = spark.createDataFrame(
        [("A & B", "prijs", "5", ""), ("C", "prijs", "  ", "")],
        "naam string, veld string, correctie string, opmerking string"
    )
    sinks.append_reports(rows, f"{tmp_path}/reports")
    sinks.append_reports(rows, f"{tmp_path}/reports")
    got = sinks.read_reports(spark, f"{tmp_path}/reports").collect()
    assert [(r.naam, r.status) for r in got] == [("A &amp; B", "nieuw")] * 2
    sinks.save_favourites(rows, f"{tmp_path}/favourites")
    kept = curation.favourites_of(
        spark.createDataFrame([("C",), ("D",)], "naam string"), sinks.read_favourites(spark, f"{tmp_path}/favourites")
    )
    assert [r.naam for r in kept.collect()] == ["C"]


def test_payload_files(spark, tmp_path):
    payload = {"elements": [
        {"type": "node", "lat": 52.1, "lon": 5.1, "tags": {"tourism": "caravan_site", "name": "Plek", "dog": "yes", "fee": "no", "phone": "06-1 2"}},
        {"type": "way", "center": {"lat": 52.2, "lon": 5.2}, "tags": {"amenity": "parking", "motorhome": "yes", "addr:city": "Sneek"}},
        {"type": "relation", "center": {"lat": 52.2, "lon": 5.2}, "tags": {"amenity": "parking", "motorhome": "yes"}},
        {"type": "node", "lat": 0, "lon": 5.2, "tags": {"tourism": "caravan_site", "name": "Nul"}},
        {"type": "node", "lat": 52.0, "lon": 5.2, "tags": {"tourism": "caravan_site", "name": "Hotel X"}},
        {"type": "node", "lat": 60.0, "lon": 5.2, "tags": {"tourism": "caravan_site", "name": "Ver"}},
    ]}
    (tmp_path / "a.json").write_text(json.dumps(payload))
    (tmp_path / "b.json").write_text("not json")
    elements = osm.read_payloads(spark, str(tmp_path))
    got = {r.naam: r for r in osm.ingest(elements.filter(osm.in_search())).collect()}
    assert set(got) == {"Plek", "Camperplaats Sneek"}
    assert (got["Plek"].honden_toegestaan, got["Plek"].prijs, got["Plek"].telefoonnummer) == ("Ja", "Gratis", "0612")


@pytest.mark.parametrize(("seed", "small"), [(0, 10_000), (1, 10_000), (0, 0)])
def test_nearest_city_is_exact_all_over_the_globe(spark, seed, small):
    import random
    from math import asin, cos, radians, sin, sqrt

    rng = random.Random(seed)
    span = 180 if seed else 40
    cities = [
        (i, rng.uniform(-90, 90), rng.choice([-1, 1]) * (180 - rng.uniform(0, span)), "NL", f"r{i}") for i in range(300)
    ]
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)]
    points += [
        (900, 0.5, 179.9), (901, 90.0, 0.0), (902, -90.0, 77.0), (903, 89.99, -179.99), (904, 0.0, -180.0),
        (905, 0.0, 180.0)
    ]
    cities += [(900, 0.5, 179.1, "NL", "far"), (901, 0.5, -179.9, "NL", "near"), (902, 0.5, -179.9, "NL", "a tie")]

    def km(a, b, c, d):
        return 2 * 6371 * asin(
            sqrt(
                min(
                    1.0, sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2
                )
            )
        )

    want = {i: min((round(km(a, b, c, d), 6), city) for city, c, d, _, _ in cities)[1] for i, a, b in points}
    df = spark.createDataFrame(
        [*points, (999, None, 1.0), (998, float("nan"), 1.0)], "place_id long, lat_d double, lon_d double"
    )
    got = geo.nearest_city(
        df, spark.createDataFrame(cities, "city_id long, lat double, lon double, cc string, admin1 string"), small=small
    )
    assert {r.place_id: r.city_id for r in got.collect()} == want and want[900] == 901


def test_nearest_city_without_cities(spark):
    none = spark.createDataFrame([], "city_id long, lat double, lon double, cc string, admin1 string")
    assert geo.nearest_city(
        spark.createDataFrame([(1, 2.0, 3.0)], "place_id long, lat_d double, lon_d double"), none
    ).count() == 0


def test_radius_without_a_point_keeps_all(spark):
    df = S.places(spark, SF)
    assert geo.within(df, None, 5.0).count() == df.count()


def test_search_is_literal_unless_told(spark):
    df = spark.createDataFrame([(1, "a(b", "x"), (2, "ab", "(y")], "place_id long, naam string, provincie string")
    ids = lambda out: sorted(r.place_id for r in out.collect())
    assert ids(search.cascade(df, "(b")) == [1] and ids(search.cascade(df, "(y")) == [2]
    assert ids(search.cascade(df, "^a.b$", regex=True)) == [1]
    assert ids(search.cascade(df, "  ")) == [1, 2] and search.cascade(df, "zz").filter("use_ai").count() == 2


def test_filters_and_labels(spark):
    df = S.places(spark, SF)
    assert search.natural(df, "")[1] == []
    _, labels = search.natural(df, "gratis met wifi")
    assert labels == ["Gratis", "Wifi: Ja"]
    assert search.natural(df, "iets")[1] == ["Geen filters herkend"]
    assert df.drop("waterfront", "water_tanken").filter(P.extracted(["naam"], {"water": "Ja"})[0]).count() == 0
    names = spark.createDataFrame([("x",)], "naam string")
    assert search.shortlist(
        df, provinces=["Drenthe"], price="free", facilities=["stroom"], vehicles=["heavy"], favourites=names
    ).count() == 0
    assert search.shortlist(df).count() == df.count() and search.shortlist(df, price="paid").count() > 0
    for choice in P.ORDERS[:-1]:
        assert df.orderBy(*P.order_by(choice)).first() is not None


def test_merges_keep_what_is_known(spark):
    base = spark.createDataFrame(
        [(1, "Ja", "Nee"), (2, "Onbekend", "Nee"), (3, " onbekend ", "Nee")],
        "place_id long, wifi string, ai_gecheckt string"
    )
    new = spark.createDataFrame([(1, "Nee"), (2, "Ja"), (3, "Onbekend")], "place_id long, wifi string")
    assert [
        r.wifi for r in enrich.fill_unknown(base, new, ["wifi"]).orderBy("place_id").collect()
    ] == ["Ja", "Ja", " onbekend "]


def test_injected_clients(spark):
    def fetch(url):
        if url == "bad":
            raise TimeoutError("late")
        return f"text of {url}"

    rows = spark.createDataFrame([(1, "a"), (2, "bad")], "place_id long, url string")
    got = {r.url: (r.site_text, r.error) for r in enrich.fetched(rows, fetch).collect()}
    assert got == {"a": ("text of a", None), "bad": ("", "late")}

    def answer(prompt):
        return "```json\n" + json.dumps(
            {"wifi": "Ja", "telefoonnummer": "0612345678"}
        ) + "\n```" if '"naam":"A"' in prompt else "geen idee"

    base = spark.createDataFrame(
        [(1, "A", "Onbekend", "", "Nee"), (2, "B", "Onbekend", "", "Nee"), (3, "A", "Nee", "", "Ja")],
        "place_id long, naam string, wifi string, telefoonnummer string, ai_gecheckt string"
    )
    scraped = spark.createDataFrame([(1, "site")], "place_id long, site_text string")
    out = enrich.enriched(base, scraped, answer, ["naam", "wifi", "telefoonnummer"]).orderBy("place_id").collect()
    assert [(r.wifi, r.ai_gecheckt) for r in out] == [("Ja", "Ja"), ("Onbekend", "Nee"), ("Nee", "Ja")]
    assert out[0].telefoonnummer == "+31 6 1234 5678" and out[0].naam == "A"


def test_batches_and_limits(spark):
    df = S.places(spark, SF).select("place_id", "ai_gecheckt")
    got = batching.numbered(df.repartition(5)).orderBy("place_id").collect()
    assert [r.position for r in got] == list(range(len(got))) and got[7].batch == 1
    assert batching.first_unprocessed(df, 3).count() == 3 and batching.first_unprocessed(df, 0).count() == df.filter(
        "ai_gecheckt <> 'Ja'"
    ).count()
    assert quality.landing_stats(df.limit(0).selectExpr("'' AS prijs", "'' AS provincie")).first() == (0, 0, 0)


def test_stream_resumes_by_file(spark, tmp_path):
    from waypost.streaming.enrichment import enrich_stream

    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows = S.places(spark, SF).select("place_id", "naam", "provincie", "stroom", "sanitair")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    for n in (1, 2):
        rows.filter(f"place_id % 2 = {n % 2}").write.mode("append").parquet(source)
        enrich_stream(spark, source, schema, target, checkpoint).awaitTermination()
    out = spark.read.parquet(target)
    assert out.count() == rows.count() and out.filter("naam like 'Parking%' and sanitair = 'Onbekend'").count() == 0


@pytest.mark.parametrize(
    "name", ["clean_values", "normalize_province", "filter_all", "unknown_profile", "distance_labels", "landing_stats"]
)
def test_plans_stay_native(name, spark):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert plan.count("FileScan") == 1


def test_clients_wait_and_fail_over():
    from waypost.sources import clients

    waits, calls = [], []

    def busy(text):
        calls.append(text)
        if len(calls) < 3:
            raise clients.Busy
        return "done"

    assert clients.patient(busy, sleep=waits.append)("q") == "done"
    assert len(waits) == 2 and 5 <= waits[0] <= 8 and 10 <= waits[1] <= 13

    def never(_):
        raise clients.Busy

    with pytest.raises(clients.Busy):
        clients.patient(never, attempts=2, sleep=waits.append)("q")

    def late(_):
        raise TimeoutError

    assert clients.failover([late, lambda q: f"from b: {q}"], sleep=waits.append)("q") == "from b: q"
    with pytest.raises(RuntimeError):
        clients.failover([late, never], sleep=waits.append)("q")


def test_waits_between_endpoints():
    from waypost.sources import clients

    def failing(kind):
        def call(_):
            raise kind

        return call

    waits = []
    with pytest.raises(RuntimeError, match="5 tries"):
        clients.failover([failing(clients.Busy), failing(TimeoutError), failing(ValueError)], sleep=waits.append)("q")
    bounds = [(5, 9), (6, 8), (5, 7), (40, 44), (48, 50)]
    assert all(low <= w <= high for w, (low, high) in zip(waits, bounds, strict=True))
    with pytest.raises(RuntimeError):
        clients.failover([failing(ValueError)], attempts=2, sleep=waits.append)("q")
    assert len(waits) == 6  # nothing to wait for after the last try


def test_fetches_run_together_and_time_out(spark):
    import time

    from waypost.operators import enrich

    def slow(value):
        if value == "stuck":
            time.sleep(3)
        if value == "bad":
            raise ValueError("broken")
        time.sleep(0.2)
        return f"got {value}"

    values = [f"v{i}" for i in range(18)] + ["stuck", "bad", None]
    df = spark.createDataFrame([(v,) for v in values], "url string").coalesce(1)
    began = time.time()
    got = {r.url: (r.site_text, r.error) for r in enrich.fetched(df, slow, workers=7, timeout_s=1.0).collect()}
    assert time.time() - began < 12  # 20 calls of 0.2 s one by one, and one that hangs
    assert got["stuck"] == ("", "no answer within 1 s") and got["bad"] == ("", "broken") and got[None] == ("got None", None)
    assert all(got[v] == (f"got {v}", None) for v in values[:18])
