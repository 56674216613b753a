"""What surrounds injected network clients: retries, failover, geocoding, health."""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.operators.search import geocode_query

# Status codes that ask for patience, and what a key check reports for each status.
BUSY = (429, 503)
HEALTH = {200: "ok", 400: "invalid key", 403: "forbidden", 429: "rate limited"}


class Busy(Exception):
    """Raised by a client for a status in ``BUSY``."""


# Fixed values by kind of failure: seconds to wait, whether they double, seconds of jitter, whether to wait after the last try too.
WAITS = (
    (Busy, 5, True, 4, True),
    (TimeoutError, 3, True, 2, True),
    (Exception, 5, False, 2, False),
)


def patient(
    call: Callable[[str], str], attempts: int = 4, base_s: float = 5.0, jitter_s: float = 3.0,
    sleep: Callable[[float], None] = time.sleep
) -> Callable[[str], str]:
    """``call`` again after ``Busy``, waiting twice as long each time; the last failure is raised, not swallowed."""

    def run(text: str) -> str:
        for attempt in range(attempts):
            try:
                return call(text)
            except Busy:
                if attempt == attempts - 1:
                    raise
                sleep(2**attempt * base_s + random.uniform(0, jitter_s))
        raise ValueError("attempts must be positive")

    return run


def failover(
    calls: Sequence[Callable[[str], str]], attempts: int = 5, sleep: Callable[[float], None] = time.sleep
) -> Callable[[str], str]:
    """The endpoints in turn until one answers, with the waits of ``WAITS`` between them."""

    def run(query: str) -> str:
        turns = list(itertools.islice(itertools.cycle(calls), attempts))
        for attempt, call in enumerate(turns):
            try:
                return call(query)
            except Exception as e:  # noqa: BLE001  any failure of an endpoint means the next one
                failure = e
            seconds, doubles, jitter, at_last = next(w for kind, *w in WAITS if isinstance(failure, kind))
            if at_last or attempt < attempts - 1:
                sleep(seconds * (2**attempt if doubles else 1) + random.uniform(0, jitter))
        raise RuntimeError(f"no endpoint answered in {attempts} tries") from failure

    return run


def geocode(queries: DataFrame, names: DataFrame, query: str = "query") -> DataFrame:
    """S10 offline: each query with the coordinates of the place (name, lat, lon) it names, or nulls.

    The query is tried with the country added and then as it is; of places of
    one name the one with the smallest coordinates answers.
    """
    known = names.groupBy(F.lower(F.trim("name")).alias("known_")).agg(F.min(F.struct("lat", "lon")).alias("at_"))
    full = known.select(F.concat("known_", F.lit(", nederland")).alias("full_"), F.col("at_").alias("full_at_"))
    asked = queries.withColumn(
        "full_", F.lower(F.trim(geocode_query(F.col(query))))
    ).withColumn("known_", F.lower(F.trim(F.col(query))))
    found = asked.join(full, "full_", "left").join(known, "known_", "left")
    at = F.coalesce("full_at_", "at_")
    return found.withColumn("lat", at["lat"]).withColumn("lon", at["lon"]).drop("full_", "known_", "full_at_", "at_")


def health(status: Column) -> Column:
    """A key check's status as text."""
    out = F.when(status.isNull(), "unreachable")
    for code, text in HEALTH.items():
        out = out.when(status == code, text)
    return out.otherwise(F.concat(F.lit("HTTP "), status.cast("string")))
