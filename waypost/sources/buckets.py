"""The place table stored in buckets of keys, so that an upsert rewrites only the buckets it touches.

``rows/`` holds a folder a bucket (a hash of the key, modulo their number),
``layout/`` the key, the number of buckets and the columns. An upsert writes
the touched buckets anew to ``pending-…``, names that folder ``ready`` in one
rename, and then puts its buckets in the place of the old ones. If it is cut
off before the rename, nothing has changed; after it, the next reader or
writer puts in place what is ready, as often as need be: the rows are whole
and the same each time. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waypost.functions.clean import UNKNOWN
from waypost.operators.enrich import upsert
from waypost.sources.scratch import delete, exists, move

_BUCKET = "bucket_"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _put(df: DataFrame, path: str) -> None:
    df.write.partitionBy(_BUCKET).option("compression", "zstd").parquet(path)


def _lay_out(spark: SparkSession, path: str, key: str, buckets: int, schema: T.StructType) -> None:
    """The layout as one row; a new one is complete before the old one goes."""
    fresh = f"{path}/layout-{uuid.uuid4().hex}"
    spark.createDataFrame([(key, buckets, schema.json())], "key string, buckets int, columns string").coalesce(1).write.json(fresh)
    old = f"{path}/layout"
    delete(spark, old)
    move(spark, fresh, old)


def _layout(spark: SparkSession, path: str) -> tuple[str, int, T.StructType]:
    row = spark.read.schema("key string, buckets int, columns string").json(f"{path}/layout*").first()
    return row.key, row.buckets, T.StructType.fromJson(json.loads(row["columns"]))


def create(df: DataFrame, path: str, key: str = "place_id", buckets: int = 256) -> None:
    """A new table at ``path``; ``buckets`` should make one bucket some hundred megabytes."""
    _put(df.withColumn(_BUCKET, _bucket(key, buckets)).repartition(buckets, _BUCKET), f"{path}/rows")
    _lay_out(df.sparkSession, path, key, buckets, df.schema)


def recover(spark: SparkSession, path: str) -> None:
    """Puts in place what an upsert that was cut off had made ready."""
    ready = f"{path}/ready"
    if exists(spark, ready):
        _, _, schema = _layout(spark, path)
        whole = T.StructType([*schema, T.StructField(_BUCKET, T.IntegerType())])
        spark.read.schema(whole).parquet(ready).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
            "compression", "zstd"
        ).partitionBy(_BUCKET).parquet(f"{path}/rows")
        delete(spark, ready)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows; columns that came in later are unknown where a bucket was written before."""
    recover(spark, path)
    return _stored(spark, path).drop(_BUCKET)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    _, _, schema = _layout(spark, path)
    whole = T.StructType([*schema, T.StructField(_BUCKET, T.IntegerType())])
    return spark.read.schema(whole).parquet(f"{path}/rows").na.fill(UNKNOWN)


def touched(spark: SparkSession, path: str, keys: DataFrame) -> list[int]:
    """The buckets of the keys, at most all of them."""
    key, buckets, _ = _layout(spark, path)
    return sorted(r[0] for r in keys.select(_bucket(key, buckets)).distinct().collect())


def rows_of(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The stored rows of the keys; only their buckets are read."""
    recover(spark, path)
    key, _, _ = _layout(spark, path)
    near = _stored(spark, path).filter(F.col(_BUCKET).isin(touched(spark, path, keys)))
    return near.drop(_BUCKET).join(keys.select(key).distinct(), key, "left_semi")


def upsert_stored(spark: SparkSession, path: str, updates: DataFrame) -> list[int]:
    """``enrich.upsert`` of the stored table, on the buckets of the updates' keys alone; returns these."""
    recover(spark, path)
    key, buckets, schema = _layout(spark, path)
    hit = touched(spark, path, updates)
    if not hit:
        return hit
    new = upsert(_stored(spark, path).filter(F.col(_BUCKET).isin(hit)), updates, key)
    columns = [c for c in new.columns if c != _BUCKET]
    added = [T.StructField(c, new.schema[c].dataType) for c in columns if c not in schema.names]
    if added:
        schema = T.StructType([*schema, *added])
        _lay_out(spark, path, key, buckets, schema)
    pending = f"{path}/pending-{uuid.uuid4().hex}"
    _put(new.select(*schema.names, _BUCKET).repartition(len(hit), _BUCKET), pending)
    move(spark, pending, f"{path}/ready")
    recover(spark, path)
    return hit
