"""Places stored along a Hilbert curve, so that a search near a point opens few files.

``save`` deals rows to files by ranges of their place on the curve (places at
one spot too many for a file are spread over several), and writes a manifest
with each file's box and number of rows. A search reads the manifest, a row a
file, takes the files whose box the circle may touch, and measures what is in
them. Places without coordinates are in files without a box, which only a
search as far as they count (``NOWHERE``) opens.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waypost.functions.geo import NOWHERE, RADIUS_KM, haversine
from waypost.operators.geo import add_distances, nearest, with_coordinates

#: Bits of each axis of the curve.
BITS = 16


def hilbert(lat: Column, lon: Column) -> Column:
    """The place of a point on a Hilbert curve over the globe; null for a point that is none."""
    n = 1 << BITS
    cell = lambda x, low, span: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((x - low) / span * n))).cast("long")
    usable = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    start = F.struct(cell(lon, -180.0, 360.0).alias("x"), cell(lat, -90.0, 180.0).alias("y"), F.lit(0).cast("long").alias("d"))

    def step(at: Column, s: Column) -> Column:
        right, upper = (F.when(at[c].bitwiseAND(s) != 0, 1).otherwise(0) for c in ("x", "y"))
        flipped = [F.when(right == 1, n - 1 - at[c]).otherwise(at[c]) for c in ("x", "y")]
        turned = upper == 0
        return F.struct(
            F.when(turned, flipped[1]).otherwise(at["x"]).alias("x"), F.when(turned, flipped[0]).otherwise(at["y"]).alias("y"),
            (at["d"] + s * s * (3 * right).bitwiseXOR(upper)).alias("d")
        )

    sides = F.array(*[F.lit(1 << i).cast("long") for i in reversed(range(BITS))])
    return F.when(usable, F.aggregate(sides, start, step, lambda at: at["d"]))


def save(df: DataFrame, path: str, files: int) -> None:
    """The rows (place_id, latitude, longitude and more) in about ``files`` files below a new path, and their manifest."""
    spark = df.sparkSession
    located = with_coordinates(df)
    along = located.withColumn("along_", hilbert(F.col("lat_d"), F.col("lon_d")))
    order = (F.asc_nulls_last("along_"), F.xxhash64("place_id"))
    along.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("along_").write.parquet(f"{path}/rows")
    boxes = spark.read.parquet(f"{path}/rows").select("lat_d", "lon_d", F.col("_metadata.file_path").alias("file"))
    ends = [f(c).alias(f"{f.__name__}_{c[:3]}") for f in (F.min, F.max) for c in ("lat_d", "lon_d")]
    boxes.groupBy("file").agg(F.count("*").alias("rows"), *ends).coalesce(1).write.parquet(f"{path}/manifest")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def _touching(lat: float, lon: float, km: float) -> Column:
    """Whether a file's box may hold a point within ``km``: by a band of latitudes and one of longitudes, across the date line too."""
    angle = min(km / RADIUS_KM * (1 + 1e-9) + 1e-9, math.pi)
    degrees = math.degrees(angle)
    south, north = lat - degrees, lat + degrees
    band = (F.col("max_lat") >= south) & (F.col("min_lat") <= north)
    if south <= -90 or north >= 90:  # a pole is within: any longitude
        return band
    half = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat))))) + 1e-9
    either = F.lit(False)
    for turn in (-360.0, 0.0, 360.0):
        either = either | ((F.col("max_lon") >= lon - half + turn) & (F.col("min_lon") <= lon + half + turn))
    return band & either


def files_near(spark: SparkSession, path: str, lat: float, lon: float, km: float) -> list[str]:
    """The files to open for a circle; as many names as the circle has files."""
    manifest = _manifest(spark, path)
    wanted = manifest if km >= NOWHERE else manifest.filter(_touching(lat, lon, km))
    return [r.file for r in wanted.select("file").collect()]


def _read(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    whole = spark.read.parquet(f"{path}/rows")
    found = spark.read.schema(whole.schema).parquet(*files) if files else whole.limit(0)
    return found.drop("lat_d", "lon_d")


def within(spark: SparkSession, path: str, point: tuple[float, float], km: float) -> DataFrame:
    """The stored places within ``km`` of a point, with afstand_km and afstand_label."""
    near = _read(spark, path, files_near(spark, path, *point, km))
    return add_distances(near, *point).filter(F.col("afstand_km") <= km)


def nearest_stored(spark: SparkSession, path: str, lat: float, lon: float, k: int) -> DataFrame:
    """O1: the ``k`` nearest stored places, by rings that grow until ``k`` places are in one.

    Files sorted by their farthest corner tell a radius that holds ``k`` places
    but for the bulge of large boxes; the first ring has an eighth of it. What a
    ring holds is counted, so the result is exact.
    """
    far = F.greatest(*[
        haversine(F.lit(float(lat)), F.lit(float(lon)), F.col(a), F.col(o)) for a in ("min_lat", "max_lat") for o in ("min_lon", "max_lon")
    ])
    held = F.sum("rows").over(Window.orderBy("far").rowsBetween(Window.unboundedPreceding, 0))
    reach = _manifest(spark, path).filter("min_lat is not null").select("rows", far.alias("far")).withColumn("held", held)
    enough = reach.filter(F.col("held") >= k).agg(F.min("far")).first()[0]
    km = NOWHERE if enough is None else max(enough / 8, 0.001)
    while km < NOWHERE:
        if within(spark, path, (lat, lon), km).limit(k).count() >= k:
            break
        km *= 2
    return nearest(_read(spark, path, files_near(spark, path, lat, lon, km)), lat, lon, k)
