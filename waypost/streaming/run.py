"""The whole enrichment run as a stream: scraped rows arrive, a micro-batch is one step of the run.

Each micro-batch reads the places it is about from the bucketed table, lets
``enrich.batch_run`` make of them what the model says, upserts the touched
buckets and files its progress: its number, and how many rows came since the
last snapshot and the last sync. A micro-batch that comes again after a
restart finds its number filed and does nothing; one that was cut off before
finds its rows as they were, or already processed, and ends up the same. So
every row is applied exactly once.

Snapshots (CSV) and syncs (the whole table) are written as soon as enough rows
have come (K2), and both when a run ends. The stop flag is looked at before each
micro-batch; a stopped run leaves that micro-batch to the next run.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from waypost.operators import enrich, quality
from waypost.sources import buckets
from waypost.sources.scratch import exists, filed
from waypost.sources.sinks import save

# Rows after which a snapshot and a sync are due.
SNAPSHOT_ROWS, SYNC_ROWS = 25, 50
_PROGRESS = "batch long, " + ", ".join(f"{c} long" for c in quality.COUNTERS) + ", seconds double, since_snapshot long, since_sync long"


class Stopped(Exception):
    """Raised in a stream whose stop flag is set."""


@dataclass
class Run:
    """What a run needs: the table's path, the model, and where progress, snapshots and syncs go."""

    spark: SparkSession
    store: str
    progress: str
    answer: Callable[[str], str]
    answer_again: Callable[[str], str]
    columns: list[str]
    snapshot: str | None = None
    sync: str | None = None
    stop: Callable[[], bool] = lambda: False

    def last(self) -> tuple[int, int, int]:
        """(number, rows since the last snapshot, rows since the last sync) of the last micro-batch that was filed."""
        if not exists(self.spark, self.progress):
            return -1, 0, 0
        row = self.spark.read.schema(_PROGRESS).json(self.progress).orderBy(F.desc("batch")).first()
        return (-1, 0, 0) if row is None else (row.batch, row.since_snapshot, row.since_sync)

    def step(self, scraped: DataFrame, number: int) -> None:
        if self.stop():
            raise Stopped
        last, since_snapshot, since_sync = self.last()
        if number <= last:
            return
        began, seen = time.monotonic(), Observation()
        scraped = filed(scraped, "scraped")
        base = buckets.rows_of(self.spark, self.store, scraped.select("place_id"))
        run = enrich.batch_run(base, scraped, self.answer, self.answer_again, self.columns)
        done = filed(run.observe(seen, *quality.counters(F.col("succeeded"))), "step")  # counted as it is written
        buckets.upsert_stored(self.spark, self.store, enrich.values(done))
        counts = [seen.get[c] for c in quality.COUNTERS]
        since_snapshot, since_sync = self.saved(since_snapshot + counts[0], since_sync + counts[0], SNAPSHOT_ROWS, SYNC_ROWS)
        made = self.spark.createDataFrame([(number, *counts, time.monotonic() - began, since_snapshot, since_sync)], _PROGRESS)
        made.coalesce(1).write.mode("append").json(self.progress)

    def totals(self, todo: int) -> DataFrame:
        """The counters of all micro-batches so far, the share of ``todo`` rows that is done, the time taken and the time left."""
        filed_ = self.spark.read.schema(_PROGRESS).json(self.progress)
        sums = quality.with_share(filed_.agg(*[F.sum(c).alias(c) for c in quality.COUNTERS], F.sum("seconds").alias("seconds")))
        share, taken, left = quality.run_times(F.col("processed"), F.lit(todo), F.col("seconds"))
        return sums.select(*quality.COUNTERS, "pct", share.alias("done"), taken.alias("elapsed"), left.alias("eta"))

    def saved(self, since_snapshot: int, since_sync: int, snapshot_rows: int, sync_rows: int) -> tuple[int, int]:
        """Writes what is due; the rows since then."""
        table = buckets.read(self.spark, self.store)
        if self.snapshot and since_snapshot >= snapshot_rows:
            table.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(self.snapshot)
            since_snapshot = 0
        if self.sync and since_sync >= sync_rows:
            save(table, self.sync)
            since_sync = 0
        return since_snapshot, since_sync


def run(job: Run, source: str, schema: str, checkpoint: str, files: int = 1) -> bool:
    """Takes what is new in ``source``, ``files`` files a micro-batch; whether it came to its end."""
    rows = job.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = rows.writeStream.foreachBatch(job.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not job.stop():
            raise
        return False
    finally:
        _, since_snapshot, since_sync = job.last()
        job.saved(since_snapshot, since_sync, 1, 1)  # the forced save at a run's end
    return True
