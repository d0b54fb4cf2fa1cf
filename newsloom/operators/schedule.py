"""The crawl schedule as a table: feed_id, interval_minutes, next_run_at, paused. Operations give a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEDULE = "feed_id string, interval_minutes int, next_run_at timestamp, paused boolean"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEDULE)


def of_registry(registry: DataFrame, as_of: Column) -> DataFrame:
    """Every enabled feed, first due an interval from now."""
    return registry.filter("enabled").select("feed_id", F.col("crawl_interval_minutes").alias("interval_minutes"), _after(as_of, F.col("crawl_interval_minutes")).alias("next_run_at"), F.lit(False).alias("paused"))


def _after(at: Column, minutes: Column) -> Column:
    return at + F.make_dt_interval(mins=minutes)


def add(schedule: DataFrame, feed_id: str, interval_minutes: int, as_of: Column) -> DataFrame:
    """A feed that is scheduled already gets the new interval and time."""
    minutes = F.lit(interval_minutes)
    new = schedule.sparkSession.range(1).select(F.lit(feed_id).alias("feed_id"), minutes.alias("interval_minutes"), _after(as_of, minutes).alias("next_run_at"), F.lit(False).alias("paused"))
    return remove(schedule, feed_id).unionByName(new)


def remove(schedule: DataFrame, feed_id: str) -> DataFrame:
    return schedule.filter(F.col("feed_id") != feed_id)


def _change(schedule: DataFrame, feed_id: str, **changes: Column) -> DataFrame:
    mine = F.col("feed_id") == feed_id
    return schedule.select(*[F.when(mine, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in schedule.columns])


def pause(schedule: DataFrame, feed_id: str) -> DataFrame:
    """A paused feed has no next run. Unknown feeds are no error, here and below."""
    return _change(schedule, feed_id, paused=F.lit(True), next_run_at=F.lit(None).cast("timestamp"))


def resume(schedule: DataFrame, feed_id: str, as_of: Column) -> DataFrame:
    return _change(schedule, feed_id, paused=F.lit(False), next_run_at=_after(as_of, F.col("interval_minutes")))


def trigger(schedule: DataFrame, feed_id: str, as_of: Column) -> DataFrame:
    """Due at once."""
    return _change(schedule, feed_id, next_run_at=as_of)


def due(schedule: DataFrame, as_of: Column) -> DataFrame:
    return schedule.filter(F.col("next_run_at") <= as_of)


def ran(schedule: DataFrame, feeds: DataFrame, as_of: Column) -> DataFrame:
    """After a run of feeds(feed_id): their next time."""
    done = schedule.join(feeds.select("feed_id", F.lit(True).alias("ran")).distinct(), "feed_id", "left")
    later = F.when(F.col("ran") & ~F.col("paused"), _after(as_of, F.col("interval_minutes"))).otherwise(F.col("next_run_at"))
    return done.select("feed_id", "interval_minutes", later.alias("next_run_at"), "paused")


def stats(schedule: DataFrame) -> DataFrame:
    """feed_id, name, next_run_time (ISO, null while paused), trigger, paused."""
    return schedule.select(
        "feed_id", F.concat(F.lit("Crawl "), F.col("feed_id")).alias("name"), F.date_format("next_run_at", "yyyy-MM-dd'T'HH:mm:ss").alias("next_run_time"),
        F.concat(F.lit("every "), F.col("interval_minutes"), F.lit(" minutes")).alias("trigger"), "paused",
    )
