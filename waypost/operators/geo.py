"""Distances to a point, and the nearest place of a gazetteer."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.functions.clean import number
from waypost.functions.geo import NOWHERE, RADIUS_KM, distance_label, haversine, measured
from waypost.sources.scratch import filed


def with_coordinates(df: DataFrame) -> DataFrame:
    """Typed coordinates, null where the text isn't a number."""
    return df.withColumns({"lat_d": number(F.col("latitude")), "lon_d": number(F.col("longitude"))})


def add_distances(df: DataFrame, lat: float, lon: float) -> DataFrame:
    """afstand_km and its label; a place without coordinates is nowhere."""
    located = with_coordinates(df)
    located = located.withColumn("km_", measured(float(lat), float(lon), F.col("lat_d"), F.col("lon_d")))
    km = F.col("km_")
    usable = F.col("lat_d").isNotNull() & F.col("lon_d").isNotNull()
    unknown_input = F.isnan("lat_d") | F.isnan("lon_d")
    known = F.when(~usable, NOWHERE).when(F.isnan(km) & ~unknown_input, NOWHERE).otherwise(km)
    return located.withColumn("afstand_km", known).withColumn(
        "afstand_label", distance_label(F.col("afstand_km"))
    ).drop("lat_d", "lon_d", "km_")


def nearest(df: DataFrame, lat: float, lon: float, k: int) -> DataFrame:
    """O1: the ``k`` nearest, by distance and place_id."""
    return add_distances(df, lat, lon).orderBy(F.asc_nulls_last("afstand_km"), "place_id").limit(k)


def within(df: DataFrame, point: tuple[float, float] | None, km: float) -> DataFrame:
    """Places within ``km``; without a point all of them.

    A band of latitudes is cut first, on the parsed number; it is a little
    wider than the radius, so the circle decides.
    """
    if point is None:
        return df
    lat, lon = point
    band = F.coalesce(F.abs(number(F.col("latitude")) - lat) <= km / 111.0 + 0.01, F.lit(False))
    return add_distances(df.filter(band), lat, lon).filter(F.col("afstand_km") <= km)


def centroid(df: DataFrame) -> DataFrame:
    """The middle of the map, its zoom, and how many places it shows."""
    located = with_coordinates(df)
    n = F.count("*")
    return located.agg(
        F.coalesce(F.avg("lat_d"), F.lit(52.3)).alias("lat"), F.coalesce(F.avg("lon_d"), F.lit(5.3)).alias("lon"),
        F.when(n == 0, 7).when(n > 15, 8).otherwise(11).alias("zoom"), F.least(n, F.lit(300)).alias("shown")
    )


_AXES, _CELL = ["u_0", "u_1", "u_2"], ["cell_0", "cell_1", "cell_2"]
_CITY = ["city_id", "cc", "admin1"]
#: Squared chords closer than this are told apart by kilometres.
_CLOSE = 1e-8


def _on_sphere(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """With the point of the unit sphere; a grid in space has no date line and no poles."""
    a, o = F.radians(lat), F.radians(lon)
    return df.withColumns(dict(zip(_AXES, (F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)), strict=True)))


def _cells(size: float) -> list[Column]:
    return [F.floor(F.col(u) / size).cast("long") for u in _AXES]


def _around(cities: DataFrame, size: float) -> DataFrame:
    """Each city in its cell and the 26 around it."""
    steps = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    spread = cities.select("lat", "lon", *_AXES, *_CITY, *[x.alias(c) for c, x in zip(_CELL, _cells(size), strict=True)])
    for c in _CELL:
        spread = spread.withColumn("step_", F.explode(steps)).withColumn(c, F.col(c) + F.col("step_")).drop("step_")
    return spread


def _reach(size: float) -> float:
    """Kilometres within which a cell's surroundings hold every city: a chord of one cell."""
    return 2 * RADIUS_KM * math.asin(min(1.0, size / 2)) * (1 - 1e-9) - 1e-5


def _grids(cities: DataFrame) -> tuple[int, list[float]]:
    """The number of cities, and cell sizes: their mean spacing over the area they span, then eightfold up to the globe."""
    ends = [f(u).alias(f"{f.__name__}_{u}") for u in _AXES for f in (F.min, F.max)]
    row = cities.agg(F.count("*").alias("n"), *ends).first()
    spans = sorted(row[f"max_{u}"] - row[f"min_{u}"] for u in _AXES) if row.n else [0.0, 0.0, 0.0]
    sizes = [min(0.7, max(1e-4, math.sqrt(spans[1] * spans[2] / max(row.n, 1))))]
    while sizes[-1] < 2:
        sizes.append(sizes[-1] * 8)
    return row.n, sizes


def nearest_city(df: DataFrame, cities: DataFrame, small: int = 4000) -> DataFrame:
    """Each row (place_id, lat_d, lon_d) with the nearest city's city_id, cc, admin1; ties go to the lowest city_id.

    An exact search without a cross join. Cities are spread over the cells of a
    grid, as fine as the cities stand; a place looks in its own cell, and its
    best find is sure if it is nearer than the cell's surroundings reach. What
    isn't sure looks again in cells eight times as wide, until they span the
    globe. Up to ``small`` cities, the grids are broadcast as a list of cities a
    cell, and places aren't shuffled, unless they are in fewer partitions than
    there are cores.
    """
    here = df.filter(
        "lat_d is not null and lon_d is not null and not isnan(lat_d) and not isnan(lon_d)"
    ).select("place_id", "lat_d", "lon_d")
    cities = _on_sphere(cities.select("lat", "lon", *_CITY), "lat", "lon")
    n, sizes = _grids(cities)
    found = _nearest_of_few if n <= small else _nearest_of_many
    cores = df.sparkSession.sparkContext.defaultParallelism
    if here.rdd.getNumPartitions() < cores:  # few input files: looking up is more work than dealing three columns out
        here = here.repartition(cores)
    return found(_on_sphere(here, "lat_d", "lon_d"), cities, sizes).select("place_id", *[F.col("b")[c].alias(c) for c in _CITY])


def _candidate(city: Column) -> Column:
    km = haversine(F.col("lat_d"), F.col("lon_d"), city["lat"], city["lon"])
    return F.struct(F.round(km, 6).alias("km"), *[city[c].alias(c) for c in _CITY])


def _nearest_in(cities: str) -> Column:
    """The best of a list: by squared chords, and by kilometres among those that are equally near."""
    apart = lambda c: sum(((F.col(u) - c[u]) * (F.col(u) - c[u]) for u in _AXES), F.lit(0.0))
    least = F.array_min(F.transform(cities, apart))
    near = lambda m: F.array_min(F.transform(F.filter(cities, lambda c: apart(c) <= m + _CLOSE), _candidate))
    return F.transform(F.array(least), near)[0]  # bound by the lambda, or it would be worked out anew for each city


def _nearest_of_few(here: DataFrame, cities: DataFrame, sizes: list[float]) -> DataFrame:
    """By broadcast lists: places keep their partitions, and look in a wider grid only where the one before isn't sure."""
    rows = here.withColumn("b", F.lit(None).cast("struct<km: double, city_id: long, cc: string, admin1: string>"))
    for i, size in enumerate(sizes):
        lists = _around(cities, size).groupBy(*_CELL).agg(F.collect_list(F.struct("lat", "lon", *_AXES, *_CITY)).alias("near_"))
        unsure = F.col("b").isNull() if i == 0 else F.col("b").isNull() | (F.col("b.km") > _reach(sizes[i - 1]))
        own = [F.when(unsure, x).alias(c) for c, x in zip(_CELL, _cells(size), strict=True)]
        rows = rows.select("*", *own).join(F.broadcast(lists), _CELL, "left")
        rows = rows.withColumn("b", F.coalesce(_nearest_in("near_"), "b")).drop("near_", *_CELL)
    return rows.select("place_id", "b").filter("b is not null")


def _nearest_of_many(here: DataFrame, cities: DataFrame, sizes: list[float]) -> DataFrame:
    """By joins on the cell, a round a grid; each round is written, so none is worked out again."""
    found, rest = [], here
    for size in sizes:
        near = rest.select("place_id", "lat_d", "lon_d", *[x.alias(c) for c, x in zip(_CELL, _cells(size), strict=True)])
        near = near.join(_around(cities, size), _CELL)
        best = near.groupBy("place_id", "lat_d", "lon_d").agg(
            F.min(_candidate(F.struct("lat", "lon", *_CITY))).alias("b")
        )
        sure = best if size >= 2 else best.filter(F.col("b.km") <= _reach(size))
        sure = filed(sure.select("place_id", "b"), "nearest")
        found.append(sure)
        rest = filed(rest.join(sure.select("place_id"), "place_id", "left_anti"), "unsure")
        if rest.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, found)


def in_country(df: DataFrame, cities: DataFrame, country: str = "NL") -> DataFrame:
    """Places nearest to a city of ``country``; their province is that city's region."""
    named = with_coordinates(df)
    near = nearest_city(named, cities)
    return named.drop("provincie", "lat_d", "lon_d").join(
        near.filter(F.col("cc") == country).select("place_id", F.col("admin1").alias("provincie")), "place_id"
    )
