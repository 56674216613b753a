"""Writers: whole-table replacement with a snapshot, and appended reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypost.functions.clean import UNKNOWN, escape_html, stripped

REPORT = "timestamp string, naam string, veld string, correctie string, opmerking string, status string"


def save(df: DataFrame, path: str, snapshot: str | None = None) -> None:
    """K1, K5: sentinel for nulls, lists and structs as JSON text; the table at ``path``, then a CSV snapshot."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
    flat = df.withColumns({c: F.to_json(c) for c in nested}).na.fill(UNKNOWN)
    flat.write.mode("overwrite").parquet(path)
    if snapshot:
        df.sparkSession.read.parquet(path).write.mode("overwrite").options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(snapshot)


def append_reports(df: DataFrame, path: str) -> None:
    """K4: corrections (naam, veld, correctie, opmerking) that say something, stamped as new, the name escaped."""
    rows = df.filter(stripped(F.col("correctie")) != "").select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        escape_html(F.col("naam")).alias("naam"), "veld", "correctie", "opmerking", F.lit("nieuw").alias("status")
    )
    rows.write.mode("append").json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """S8."""
    return spark.read.schema(REPORT).json(path)


def save_favourites(df: DataFrame, path: str) -> None:
    """K3."""
    df.select("naam").write.mode("overwrite").json(path)


def read_favourites(spark: SparkSession, path: str) -> DataFrame:
    """S7."""
    return spark.read.schema("naam string").json(path)
