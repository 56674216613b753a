"""Aggregates over the place table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from waypost.functions.predicates import NO_OPTION, free, unprocessed

# The profiled fields, and the planning constants of a run.
PROFILED = [
    "prijs", "honden_toegestaan", "stroom", "sanitair", "wifi", "water_tanken", "afvalwater", "beoordeling",
    "beschrijving", "telefoonnummer", "provincie", "drukte_indicator", "max_lengte", "remote_work_score"
]
BATCH, WORKERS, SCRAPE_S, MODEL_S, PAUSE_S = 5, 10, 3.0, 4.0, 1.5


def landing_stats(df: DataFrame) -> DataFrame:
    """A1: rows, free rows, distinct provinces (the sentinel counts as one)."""
    return df.agg(
        F.count("*").alias("total"), F.count_if(free()).alias("gratis"),
        F.count_distinct("provincie").alias("provincies")
    )


def unknown_profile(df: DataFrame) -> DataFrame:
    """A2: per field that is there, how many rows say unknown; one scan, one aggregate row, then unpivoted."""
    fields = [c for c in PROFILED if c in df.columns]
    counted = df.agg(F.count("*").alias("rows_"), *[F.count_if(F.lower(c) == "onbekend").alias(c) for c in fields])
    long = counted.unpivot(["rows_"], fields, "veld", "onbekend")
    return long.select(
        "veld", "onbekend", F.round(F.col("onbekend") / F.greatest("rows_", F.lit(1)) * 100, 1).alias("pct")
    )


def province_options(df: DataFrame) -> DataFrame:
    """A3, F18."""
    return df.filter(~F.lower("provincie").isin(NO_OPTION)).select("provincie").distinct().orderBy("provincie")


def progress(df: DataFrame) -> DataFrame:
    """A4, A10: done, to do, and batches to run."""
    todo = F.count_if(unprocessed())
    return df.agg((F.count("*") - todo).alias("done"), todo.alias("todo"), F.ceil(todo / BATCH).alias("batches"))


def preset(options: DataFrame, wanted: str | None) -> DataFrame:
    """the options, of which the one that equals ``wanted`` is chosen; a preset that isn't an option chooses none."""
    return options.withColumn("chosen", F.coalesce(F.col("provincie") == F.lit(wanted), F.lit(False)))


def run_times(processed: Column, total: Column, seconds: Column) -> tuple[Column, Column, Column]:
    """The share done, the time taken, and the time left at this speed."""
    spell = lambda s: F.format_string("%dm %ds", F.floor(s / 60), F.floor(s) % 60)
    left = (total - processed) * (seconds / processed)
    share = F.when(total == 0, 0.0).otherwise(processed / total * 100)
    return share, spell(seconds), F.when(processed == 0, "–").otherwise(F.concat(F.lit("~"), spell(left)))


#: Counters of a run, in their order.
COUNTERS = ("processed", "succeeded", "skipped", "fallback")


def counters(succeeded: Column) -> list[Column]:
    """The counters of a run's rows (skipped, fallback), to aggregate or to observe."""
    counts = (F.count("*"), F.count_if(F.coalesce(succeeded, F.lit(False))), F.count_if("skipped"), F.count_if("fallback"))
    return [n.alias(c) for c, n in zip(COUNTERS, counts, strict=True)]


def with_share(counted: DataFrame) -> DataFrame:
    return counted.withColumn("pct", F.round(F.col("succeeded") / F.greatest("processed", F.lit(1)) * 100, 1))


def run_counters(results: DataFrame) -> DataFrame:
    """Processed, succeeded, skipped, fallback, and the share that succeeded."""
    return with_share(results.agg(*counters(F.col("naam") != "")))


def run_observed(results: DataFrame, write: Callable[[DataFrame], None]) -> DataFrame:
    """A7 in flight: the same counters, taken while ``write`` writes the results; nothing is read a second time."""
    seen = Observation()
    write(results.observe(seen, *counters(F.col("naam") != "")))
    row = tuple(seen.get[c] for c in COUNTERS)
    return with_share(results.sparkSession.createDataFrame([row], ", ".join(f"{c} long" for c in COUNTERS)))


def minutes(n: Column) -> Column:
    """The planned minutes for ``n`` rows."""
    return n / WORKERS * SCRAPE_S / 60 + n / BATCH * (MODEL_S + PAUSE_S) / 60


def minutes_label(n: Column) -> Column:
    low, high = F.floor(minutes(n)).cast("string"), F.floor(minutes(n) * 1.4).cast("string")
    return F.concat(F.lit("~"), low, F.lit(" – "), high, F.lit(" minuten"))
