"""Circuit breakers and retries over fetch events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

THRESHOLD, MINUTES = 3, 10


def openings(events: DataFrame, threshold: int = THRESHOLD, minutes: int = MINUTES) -> DataFrame:
    """feed_id, ts, failures, open_until for each failure that opens or extends a feed's breaker.

    events: feed_id, event_id, ts, failed. A run of failures ends with a success; its
    length so far is a running count within (feed, successes before).
    """
    order = W.partitionBy("feed_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    runs = events.withColumn("run", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(order)).filter("failed")
    place = W.partitionBy("feed_id", "run").orderBy("ts", "event_id")
    counted = runs.withColumn("failures", F.row_number().over(place).cast("long")).filter(F.col("failures") >= threshold)
    return counted.select("feed_id", "event_id", "ts", "failures", (F.col("ts") + F.make_dt_interval(mins=F.lit(minutes))).alias("open_until"))


def retry_schedule(spark: SparkSession, backoff_seconds: int = 30, retries: int = 5) -> DataFrame:
    """attempt (from 0), wait_seconds after it, started_at_seconds."""
    a = spark.range(retries + 1).withColumnRenamed("id", "attempt")
    wait = F.when(F.col("attempt") < retries, backoff_seconds * F.pow(F.lit(2), "attempt")).otherwise(0).cast("long")
    return a.select("attempt", wait.alias("wait_seconds"), (backoff_seconds * (F.pow(F.lit(2), "attempt") - 1)).cast("long").alias("started_at_seconds"))


STATE = "feed_id string, failures long, open_until timestamp"


def guarded(feeds: DataFrame, state: DataFrame, as_of: Column) -> DataFrame:
    """feeds with circuit_open, by state(feed_id, failures, open_until)."""
    return feeds.join(state.select("feed_id", "open_until"), "feed_id", "left").withColumn("circuit_open", F.coalesce(F.col("open_until") >= as_of, F.lit(False))).drop("open_until")


def after(state: DataFrame, fetched: DataFrame, as_of: Column, threshold: int = THRESHOLD, minutes: int = MINUTES) -> DataFrame:
    """The next state: a success clears a feed's failures, as does the end of its breaker's time; a failed call adds one, a call that the breaker stopped changes nothing."""
    new = fetched.select("feed_id", F.col("error").alias("_error"), F.lit(True).alias("_asked"))
    both = state.join(new, "feed_id", "full_outer")
    stopped = F.col("_asked").isNull() | (F.col("_error") == "CIRCUIT_BREAKER_OPEN")
    had = F.when(F.coalesce(F.col("open_until") < as_of, F.lit(False)), 0).otherwise(F.coalesce("failures", F.lit(0)))
    failures = F.when(F.coalesce(stopped, F.lit(False)), F.coalesce("failures", F.lit(0))).when(F.col("_error").isNull(), 0).otherwise(had + 1)
    both = both.select("feed_id", failures.cast("long").alias("failures"), F.coalesce(stopped, F.lit(False)).alias("_stopped"), F.col("open_until").alias("_until"))
    until = F.when(F.col("_stopped"), F.col("_until")).when(F.col("failures") >= threshold, as_of + F.make_dt_interval(mins=F.lit(minutes)))
    return both.select("feed_id", "failures", until.alias("open_until"))
