"""Places stored along a curve: searches open few files and find what a scan finds."""

import random

import pytest
from pyspark.sql import functions as F
from tests.conftest import SF
from waypost.operators import geo
from waypost.sources import spatial
from waypost.sources.places import places


def curve(x, y, bits=spatial.BITS):
    """The place of a cell on the curve, by the usual loop."""
    n, d, s = 1 << bits, 0, 1 << bits - 1
    while s:
        rx, ry = int(x & s > 0), int(y & s > 0)
        d += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = n - 1 - x, n - 1 - y
            x, y = y, x
        s >>= 1
    return d


def test_curve(spark):
    rng = random.Random(1)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0)]
    rows = spark.createDataFrame([*points, (None, 1.0), (float("nan"), 1.0)], "lat double, lon double")
    n = 1 << spatial.BITS
    cell = lambda v, low, span: min(n - 1, int((v - low) / span * n))
    got = {(r.lat, r.lon): r.d for r in rows.select("lat", "lon", spatial.hilbert(F.col("lat"), F.col("lon")).alias("d")).limit(303).collect()}
    assert got == {(a, o): curve(cell(o, -180, 360), cell(a, -90, 180)) for a, o in points}
    assert {r.d for r in rows.select(spatial.hilbert(F.col("lat"), F.col("lon")).alias("d"), "lat").filter("lat is null or isnan(lat)").collect()} == {None}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(2)
    spots = [(rng.uniform(50.5, 53.5), rng.uniform(3.4, 7.2)) for _ in range(4000)] + [(52.0, 5.0)] * 900
    spots += [(rng.uniform(-20, 20), rng.choice([179.5, -179.5]) + rng.uniform(-0.5, 0.5)) for _ in range(300)] + [(89.9, rng.uniform(-180, 180)) for _ in range(50)]
    rows = [(i, f"{a:.5f}", f"{o:.5f}", "own") for i, (a, o) in enumerate(spots)] + [(9000 + i, "Onbekend", "5.0", "own") for i in range(20)]
    df = spark.createDataFrame(rows, "place_id long, latitude string, longitude string, along_ string")
    path = str(tmp_path_factory.mktemp("spatial") / "a")
    spatial.save(df.drop("along_"), path, 80)
    return df.drop("along_"), path


CIRCLES = [((52.0, 5.0), 10.0), ((52.3, 5.3), 10.0), ((0.0, 180.0), 100.0), ((0.0, -179.9), 60.0), ((89.5, 10.0), 80.0), ((10.0, 60.0), 10.0), ((52.0, 5.0), 9999.0)]


@pytest.mark.parametrize("point, km", CIRCLES)
def test_circles_equal_the_scan(spark, stored, point, km):
    df, path = stored
    got = {(r.place_id, r.afstand_km) for r in spatial.within(spark, path, point, km).collect()}
    assert got == {(r.place_id, r.afstand_km) for r in geo.add_distances(df, *point).filter(F.col("afstand_km") <= km).collect()}


def test_few_files_are_opened(spark, stored):
    _, path = stored
    total = spatial._manifest(spark, path).count()
    assert total > 60
    small = spatial.files_near(spark, path, 52.3, 5.3, 10.0)
    assert 0 < len(small) <= total * 0.1
    assert len(spatial.within(spark, path, (52.3, 5.3), 10.0).inputFiles()) == len(small)
    assert spatial._manifest(spark, path).agg(F.max("rows")).first()[0] < 400  # nor do 900 places at one spot make one file


@pytest.mark.parametrize("point, k", [((52.3, 5.3), 1), ((52.3, 5.3), 40), ((52.0, 5.0), 950), ((0.0, 180.0), 10), ((-60.0, -100.0), 7), ((52.0, 5.0), 6000)])
def test_nearest_equal_the_scan(spark, stored, point, k):
    df, path = stored
    got = [r.place_id for r in spatial.nearest_stored(spark, path, *point, k).collect()]
    assert got == [r.place_id for r in geo.nearest(df, *point, k).collect()]


def test_empty_table(spark, tmp_path):
    spatial.save(places(spark, SF).select("place_id", "latitude", "longitude").limit(0), str(tmp_path / "none"), 4)
    assert spatial.within(spark, str(tmp_path / "none"), (52.0, 5.0), 10.0).count() == 0
    assert spatial.nearest_stored(spark, str(tmp_path / "none"), 52.0, 5.0, 3).count() == 0
