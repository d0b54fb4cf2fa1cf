"""Job counters, counters, histograms, summaries, gauges and health as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import times

#: Histogram buckets by what is timed.
BUCKETS = {"fetch": (0.1, 0.5, 1.0, 2.0, 5.0, 10.0), "parse": (0.01, 0.05, 0.1, 0.5, 1.0), "validation": (0.01, 0.05, 0.1, 0.5), "publish": (0.01, 0.05, 0.1, 0.5, 1.0)}
SEVERITY = ("healthy", "degraded", "unhealthy")
CRITICAL = ("database", "message_sink", "feed_registry")


def job_counters(evaluated: DataFrame, job: str = "job_id") -> DataFrame:
    """status is published, duplicate, invalid or error. Crawled leaves out what was invalid."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return evaluated.groupBy(job).agg(
        n("published", "duplicate", "error").alias("articles_crawled"), n("published").alias("articles_published"), n("duplicate").alias("articles_duplicate"), n("invalid", "error").alias("articles_failed")
    )


def job_rows(status: DataFrame, as_of: Column, failures: DataFrame | None = None, job_id: str = "job") -> DataFrame:
    """A job for each feed of a crawl, in the columns of the catalog's crawl_jobs: completed, with the feed's distinct rule errors, or failed, with what it failed by."""
    listed = status.withColumnRenamed("job_id", "_job").withColumn("job_id", F.concat_ws("/", "_job", "feed_id"))
    counted = job_counters(listed, "job_id")
    named = listed.groupBy("job_id").agg(F.first("feed_id").alias("feed_id"))
    errors = listed.select("job_id", F.explode("errors").alias("e")).groupBy("job_id").agg(F.array_sort(F.collect_set("e")).alias("errors"))
    iso = times.to_iso(as_of)
    done = (
        counted.join(named, "job_id").join(errors, "job_id", "left")
        .select("job_id", "feed_id", iso.alias("started_at"), iso.alias("completed_at"), F.lit("completed").alias("status"), "articles_crawled", "articles_published", "articles_failed", F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))
    )
    if failures is None:
        return done
    none = [F.lit(0).cast("long").alias(c) for c in ("articles_crawled", "articles_published", "articles_failed")]
    lost = failures.select(F.concat_ws("/", F.lit(job_id), "feed_id").alias("job_id"), "feed_id", iso.alias("started_at"), iso.alias("completed_at"), F.lit("failed").alias("status"), *none, F.array("error").alias("errors"))
    return done.unionByName(lost)


def counters(events: DataFrame, *labels: str) -> DataFrame:
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("value"))


def histogram(events: DataFrame, value: str, buckets: tuple[float, ...], *labels: str) -> DataFrame:
    """labels, le, count: cumulative, with +Inf. One pass; buckets are unfolded after counting."""
    sums = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    counted = events.groupBy(*labels).agg(*sums, F.count(value).alias("total"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(buckets)]
    return counted.select(*labels, F.inline(F.array(*rows, F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("count")))))


def summary(events: DataFrame, value: str, *labels: str) -> DataFrame:
    return events.groupBy(*labels).agg(F.count(value).alias("count"), F.sum(value).alias("sum"))


def gauge(events: DataFrame, value: str, at: Column, *labels: str) -> DataFrame:
    return events.groupBy(*labels).agg(F.max_by(value, at).alias("value"))


def health(checks: DataFrame) -> DataFrame:
    """status: the worst of all; healthy without any."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("status")), F.lit(1))
    return checks.agg(F.coalesce(F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.max(rank).cast("int")), F.lit("healthy")).alias("status"))


def ready(checks: DataFrame, critical: tuple[str, ...] = CRITICAL) -> DataFrame:
    return checks.agg(F.coalesce(~F.bool_or(F.col("name").isin(*critical) & (F.col("status") == "unhealthy")), F.lit(True)).alias("ready"))


def report(checks: DataFrame) -> DataFrame:
    """One row: overall status and a map of the checks."""
    listed = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "status"))))
    return checks.agg(listed.alias("checks")).crossJoin(F.broadcast(health(checks)))


def exposition(frame: DataFrame, name: str, value: str = "value") -> DataFrame:
    """Lines of text in the common metrics format."""
    labels = [c for c in frame.columns if c != value]
    tags = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in labels])
    return frame.select(F.concat(F.lit(name), F.when(tags != "", F.concat(F.lit("{"), tags, F.lit("}"))).otherwise(""), F.lit(" "), F.col(value).cast("string")).alias("line"))


def crawl_summary(jobs: DataFrame) -> DataFrame:
    return jobs.rollup("status").agg(F.count(F.lit(1)).alias("feeds"), F.sum("articles_published").alias("articles")).select(F.coalesce("status", F.lit("total")).alias("status"), "feeds", F.coalesce("articles", F.lit(0)).alias("articles"))
