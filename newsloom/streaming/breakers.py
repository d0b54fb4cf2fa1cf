"""Circuit breakers over a stream of fetch events, with timers that close them.

Events of a feed wait in a list state until the watermark has passed them, and are then
taken in the order of their times, so the rows do not depend on how events fall into
batches. A value state holds the failures in a row and the time up to which the breaker is open; a
timer at that time closes it even if the feed is not read again.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from newsloom.operators.breaker import MINUTES, THRESHOLD

# the process in which the driver prepares states does not get the session's path, so it cannot import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHANGES = "feed_id long, event_id long, at long, kind string, failures long, open_until long"


def changes(feed_id: int, events: list[tuple], failures: int, until: int | None, passed: int, threshold: int, micros: int) -> tuple[list[tuple], int, int | None]:
    """Rows of CHANGES for ordered events (at, event_id, failed), all before passed, and the state after them. Times are microseconds.

    A failure opens the breaker once there are threshold in a row, and extends it from then on; a
    success closes it and forgets the failures, as does its time.
    """
    out = []
    for at, event_id, failed in [*events, (passed, None, None)]:
        if until is not None and until < at:
            out.append((feed_id, None, until, "close", 0, None))
            failures, until = 0, None
        if event_id is None:
            continue
        if failed:
            failures += 1
            if failures >= threshold:
                kind, until = "open" if until is None else "extend", at + micros
                out.append((feed_id, event_id, at, kind, failures, until))
        else:
            if until is not None:
                out.append((feed_id, event_id, at, "close", 0, None))
            failures, until = 0, None
    return out, failures, until


class BreakerProcessor(StatefulProcessor):
    def __init__(self, threshold: int, minutes: int) -> None:
        self.threshold, self.micros = threshold, minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, failed boolean")
        self.breaker = handle.getValueState("breaker", "failures long, open_until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the API
        for pdf in rows:
            found = [(int(at), int(e), bool(f)) for at, e, f in zip(pdf["at"], pdf["event_id"], pdf["failed"], strict=True)]
            self.waiting.appendList(found)
            # the first to be passed is enough: its timer takes all that are ready and sets the next one
            if found:
                self.handle.registerTimer(min(found)[0] // 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(x) for x in self.waiting.get())
        ready = [x for x in waiting if x[0] < passed]
        failures, until = self.breaker.get() if self.breaker.exists() else (0, None)
        out, failures, new = changes(int(key[0]), ready, failures, until, passed, self.threshold, self.micros)
        if ready:
            rest = waiting[len(ready) :]
            self.waiting.put(rest) if rest else self.waiting.clear()
        if waiting[len(ready) :]:
            self.handle.registerTimer(waiting[len(ready)][0] // 1000)
        if ready or out:
            self.breaker.update((failures, new))
            if new is not None and new != until:
                self.handle.registerTimer(new // 1000)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")]).astype({"event_id": "Int64", "open_until": "Int64"})

    def close(self) -> None:
        pass


def breaker_changes(events: DataFrame, late: str = "10 minutes", threshold: int = THRESHOLD, minutes: int = MINUTES) -> DataFrame:
    """feed_id, event_id (null: by time), ts, kind (open, extend, close), failures, open_until for all that the watermark has passed.

    events: a stream of feed_id, event_id, ts, failed. Needs the RocksDB state store.
    """
    rows = events.select("feed_id", "event_id", "ts", F.unix_micros("ts").alias("at"), "failed").withWatermark("ts", late)
    found = rows.groupBy("feed_id").transformWithStateInPandas(BreakerProcessor(threshold, minutes), CHANGES, "append", "eventTime")
    return found.select("feed_id", "event_id", F.timestamp_micros("at").alias("ts"), "kind", "failures", F.timestamp_micros("open_until").alias("open_until"))


def with_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class BreakerStream:
    """Files of events in, files of changes out; each run takes what is there and stops. The next one goes on from the checkpoint."""

    def __init__(self, root: str, **settings) -> None:
        self.events, self.out, self.checkpoint, self.settings = f"{root}/events", f"{root}/changes", f"{root}/checkpoint", settings

    def run(self, spark: SparkSession) -> None:
        with_rocksdb(spark)
        stream = spark.readStream.schema("feed_id long, event_id long, ts timestamp, failed boolean").parquet(self.events)
        found = breaker_changes(stream, **self.settings)
        found.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start().awaitTermination()

    def result(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("feed_id long, event_id long, ts timestamp, kind string, failures long, open_until timestamp").parquet(self.out)
