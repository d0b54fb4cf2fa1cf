"""Messages and dead letters of a stream, each written once, and figures of what was delivered."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from newsloom.sources import sinks


def partition_of(key: Column, partitions: int) -> Column:
    """The partition of a key: the first 32 bits of its md5, so that any client finds the same."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % partitions


class DeliveryListener(StreamingQueryListener):
    """Observed figures of each batch of one stream by its number: a batch that is run again replaces its own."""

    def __init__(self, name: str) -> None:
        self.name, self.batches, self.query, self.ended = name, {}, None, False

    def onQueryStarted(self, event) -> None:  # noqa: N802  names of the API
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get(self.name)
        if str(event.progress.runId) == self.query and seen is not None and event.progress.numInputRows:
            self.batches[event.progress.batchId] = seen.asDict()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended = self.ended or str(event.runId) == self.query


class Producer:
    """Publishes a stream of rows with key, value, good, error: good rows to topic, others as dead letters, both in folders named by batch.

    start(), flush() and stop() are its life; report() says what each partition was given.
    """

    def __init__(self, root: str, topic: sinks.Topic = sinks.MESSAGES, dead: sinks.Topic = sinks.DEAD_LETTERS) -> None:
        self.root, self.topic, self.dead = root, topic, dead
        self.listener = DeliveryListener(f"delivery_{topic.name}")
        self.query = None

    def _batch(self, rows: DataFrame, number: int) -> None:
        # written once and read twice: each action on the batch itself would count it again
        staged = f"{self.root}/staged/batch={number}"
        rows.write.mode("overwrite").parquet(staged)
        rows = rows.sparkSession.read.schema(rows.schema).parquet(staged)
        good = rows.filter("good").select("key", "value", "partition")
        # several tasks a partition: as many as the batch was read by
        parts = max(1, -(-rows.rdd.getNumPartitions() // self.topic.partitions))
        good.repartition(self.topic.partitions * parts, "partition", F.pmod(F.xxhash64("key"), F.lit(parts))).write.mode("overwrite").option("compression", self.topic.compression).parquet(f"{self.root}/{self.topic.name}/batch={number}")
        bad = rows.filter("NOT good").select("key", "value", "error")
        bad.write.mode("overwrite").parquet(f"{self.root}/{self.dead.name}/batch={number}")

    def start(self, rows: DataFrame) -> None:
        self.spark = rows.sparkSession
        p = F.col("partition")
        counts = [F.count_if(F.col("good") & (p == i)).alias(f"delivered_{i}") for i in range(self.topic.partitions)]
        largest = [F.max(F.when(F.col("good") & (p == i), F.length("value"))).alias(f"largest_{i}") for i in range(self.topic.partitions)]
        placed = rows.withColumn("good", F.coalesce("good", F.lit(False))).withColumn("partition", partition_of(F.col("key"), self.topic.partitions))
        observed = placed.observe(self.listener.name, *counts, *largest, F.count_if(~F.col("good")).alias("refused"))
        self.spark.streams.addListener(self.listener)
        self.query = observed.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.root}/checkpoint").start()
        self.listener.query = str(self.query.runId)

    def flush(self) -> None:
        """Waits until all that has come in is written."""
        self.query.processAllAvailable()

    def stop(self, patience: float = 60.0) -> None:
        """Flushes, ends the stream and waits for the listener to have heard of it."""
        self.flush()
        self.query.stop()
        until = time.monotonic() + patience
        while not self.listener.ended and time.monotonic() < until:
            time.sleep(0.05)
        self.spark.streams.removeListener(self.listener)

    def report(self, spark: SparkSession) -> DataFrame:
        """partition, delivered, largest: one row a partition."""
        batches = list(self.listener.batches.values())
        rows = [(i, sum(b[f"delivered_{i}"] or 0 for b in batches), max((b[f"largest_{i}"] for b in batches if b[f"largest_{i}"] is not None), default=None)) for i in range(self.topic.partitions)]
        return spark.createDataFrame(rows, "partition long, delivered long, largest long")

    def refused(self) -> int:
        return sum(b["refused"] for b in self.listener.batches.values())
