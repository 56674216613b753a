"""Distances on the sphere."""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The earth's radius in km, and the distance of a place without coordinates.
RADIUS_KM, NOWHERE = 6371.0, 9999.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """G1: great-circle distance in km."""
    a = F.pow(
        F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)
    ) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * RADIUS_KM) * F.asin(F.sqrt(a))


def measured(lat: float, lon: float, lats: Column, lons: Column) -> Column:
    """G1 from one point, to the last bit what SQL engines on the C library find.

    The JVM's sines and arcsines differ from the C library's in the last bit, so
    places that are equally far but for rounding (on both sides of a point, say)
    would be ranked otherwise. Arrow computes a batch of rows at a time.
    """

    def radians(x):
        return pc.multiply(x, math.pi / 180)

    def squared(x):
        return pc.power(pc.sin(pc.divide(x, 2.0)), 2.0)

    def km(a: pa.Array, o: pa.Array) -> pa.Array:
        across = pc.multiply(pc.multiply(math.cos(math.radians(lat)), pc.cos(radians(a))), squared(radians(pc.subtract(o, lon))))
        h = pc.add(squared(radians(pc.subtract(a, lat))), across)
        return pc.multiply(2 * RADIUS_KM, pc.asin(pc.sqrt(h)))

    return F.arrow_udf(km, "double")(lats, lons)


def distance_label(km: Column) -> Column:
    """One decimal; a question mark for a place without coordinates."""
    return F.when(km < NOWHERE, F.concat(F.round(km, 1).cast("string"), F.lit(" km"))).otherwise("?")
