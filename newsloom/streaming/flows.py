"""The dataflow as streams: windows and first-wins dedup across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.lineage import checkpointed
from newsloom.operators import dedup


def tumbling(events: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "2 hours", *labels: str) -> DataFrame:
    """Counts and sums by window; for streams, events later than the watermark are dropped."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(F.window(at, width), *labels).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *labels, "n", "total")


def sessions(events: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class DedupStream:
    """First-wins dedup over micro-batches. State: the bands of kept articles, a folder for each batch.

    A batch rewrites its own folder, so a replayed batch gives the same state. ttl_batches
    bounds the state to the last batches; None keeps all.
    """

    def __init__(self, state: str, out: str, ttl_batches: int | None = None) -> None:
        self.state, self.out, self.ttl = state, out, ttl_batches

    def __call__(self, batch: DataFrame, number: int) -> None:
        """batch: arrival, title, body, publishable."""
        spark = batch.sparkSession
        # read four times below
        signed = checkpointed(dedup.signatures(batch).select("arrival", "signature", "publishable"))
        low = 0 if self.ttl is None else max(0, number - self.ttl)
        known = None
        if number:
            known = spark.read.schema("arrival long, band string, batch int").parquet(self.state).filter((F.col("batch") >= low) & (F.col("batch") < number)).select("band").distinct()
        bands = signed.select("arrival", F.explode(dedup.band_keys(F.col("signature"))).alias("band"))
        seen = bands.join(known, "band", "left_semi").select("arrival").distinct() if known is not None else spark.createDataFrame([], "arrival long")
        fresh = signed.join(seen, "arrival", "left_anti")
        decided = dedup.first_wins(fresh if known is not None else signed).unionByName(seen.select("arrival", F.lit(True).alias("is_duplicate")))
        result = signed.select("arrival", "publishable").join(decided, "arrival")
        result.write.mode("overwrite").parquet(f"{self.out}/batch={number}")
        kept = spark.read.parquet(f"{self.out}/batch={number}").filter("publishable and not is_duplicate").select("arrival")
        bands.join(kept, "arrival").write.mode("overwrite").parquet(f"{self.state}/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def result(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.out).select("arrival", "publishable", "is_duplicate")
