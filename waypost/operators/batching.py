"""Fixed-size batches in place order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waypost.functions.predicates import unprocessed
from waypost.sources.scratch import filed


def numbered(df: DataFrame, key: str = "place_id", size: int = 5) -> DataFrame:
    """The position of each row in the order of ``key``, and its batch of ``size``; rows without key come last."""
    placed = ranked(df, F.asc_nulls_last(key)).withColumn("position", F.col("rank") - 1).drop("rank")
    return placed.withColumn("batch", F.floor(F.col("position") / size))


def first_unprocessed(df: DataFrame, limit: int) -> DataFrame:
    """O3: the first ``limit`` unprocessed rows by place_id; 0 means all of them."""
    todo = df.filter(unprocessed())
    return todo.orderBy("place_id").limit(limit) if limit > 0 else todo


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """All rows with their rank from 1 in ``order``.

    The sort deals rows out by ranges of equal numbers of rows, drawn from a
    sample, each of which numbers its own; a range's first rank is a prefix sum
    over their counts, so no task sees all rows, whatever the values are. The
    sorted rows are written, as a second sort could draw other ranges; rows that
    are equal in ``order`` are numbered as they were written.
    """
    placed = df.orderBy(*order).withColumn("part_", F.spark_partition_id()).withColumn(
        "row_", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    )
    placed = filed(placed, "ranked")
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("part_").agg(F.count("*").alias("n_")).select(
        "part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_")
    )
    return placed.join(F.broadcast(bases), "part_").withColumn(
        "rank", F.col("base_") + F.col("row_") + 1
    ).drop("part_", "row_", "base_")
