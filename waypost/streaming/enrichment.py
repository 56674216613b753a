"""The enrichment run as a stream: rows that arrive are enriched and appended as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from waypost.functions.normalize import postprocess
from waypost.operators.enrich import deduced


def enrich_stream(
    spark: SparkSession, source: str, schema: str, target: str, checkpoint: str,
    step: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Reads what is new in ``source``, writes it enriched to ``target`` and stops.

    The stream's own checkpoint remembers what is done, so a run that is cut
    off resumes by file and not by a row count.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    done = postprocess(deduced(rows))
    done = step(done) if step else done
    return done.writeStream.format("parquet").option("path", target).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()
