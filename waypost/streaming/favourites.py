"""Ordered favourites as keyed state: additions and removals by event time, late ones included.

Each user and place name is a group with one state: the latest event by its
time (ties: the greater event_id), and since when the name has been a
favourite without a break. Events may come in any order; one that is older than
what is known changes nothing but that time, which is why the events of the
group that still matter, those since the last removal, are kept. The stream
writes a change a group and micro-batch; the list of a user is the last change
of each name, in the order of their times.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

EVENTS = "event_id long, ts timestamp_ntz, user_id long, naam string, adds boolean"
_STATE = "adds boolean, ts long, event_id long, since long, since_id long, version long, removed long, removed_id long"
_OUT = "user_id long, naam string, favourite boolean, since long, since_id long, version long"


class Favourite(StatefulProcessor):
    """The state of one user and name."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", _STATE)
        #: Additions since the last removal by (ts, event_id), as any of them may turn out to be the first.
        self.additions = handle.getMapState("additions", "ts long, event_id long", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        adds, at, since, version, removed = False, None, None, 0, (-(2**62), -1)
        if self.latest.exists():
            held = self.latest.get()
            adds, at, version, removed = held[0], (held[1], held[2]), held[5], (held[6], held[7])
        for frame in rows:
            for e in frame.itertuples():
                now = (int(e.ts), int(e.event_id))
                if at is None or now > at:
                    adds, at = bool(e.adds), now
                if e.adds and now > removed:
                    self.additions.updateValue(now, (True,))
                elif not e.adds and now > removed:
                    removed = now
        first = None
        for (ts, event_id) in list(self.additions.keys()):
            if (ts, event_id) <= removed:
                self.additions.removeKey((ts, event_id))
            elif first is None or (ts, event_id) < first:
                first = (ts, event_id)
        since = first if adds and first is not None else (0, -1)
        self.latest.update((adds, *at, *since, version + 1, *removed))
        yield pd.DataFrame(
            {"user_id": [key[0]], "naam": [key[1]], "favourite": [adds], "since": [since[0]], "since_id": [since[1]], "version": [version + 1]}
        )

    def close(self) -> None:
        pass


def changes(events: DataFrame) -> DataFrame:
    """The changes (user_id, naam, favourite, since, since_id, version) of a stream of events."""
    keyed = events.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp"))).groupBy("user_id", "naam")
    return keyed.transformWithStateInPandas(Favourite(), _OUT, "Update", "None")


def follow(spark: SparkSession, source: str, target: str, checkpoint: str, files: int = 1) -> StreamingQuery:
    """Events that are new in ``source`` become changes in ``target``; a restart goes on where it stopped."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(source)

    def written(batch: DataFrame, number: int) -> None:
        # a micro-batch that comes again replaces what it wrote before
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return changes(events).writeStream.foreachBatch(written).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def favourites(spark: SparkSession, target: str) -> DataFrame:
    """user_id, naam and their rank from 1 in each user's list, the oldest favourite first."""
    from pyspark.sql.window import Window

    last = spark.read.schema(_OUT).parquet(f"{target}/batch=*").groupBy("user_id", "naam").agg(
        F.max_by(F.struct("favourite", "since", "since_id"), "version").alias("x")
    )
    order = Window.partitionBy("user_id").orderBy("x.since", "x.since_id")
    return last.filter("x.favourite").select("user_id", "naam", F.row_number().over(order).alias("rank"))
