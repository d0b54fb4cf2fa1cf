"""A facade with the service's operations: health, feeds, crawls."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.config import Settings, settings
from newsloom.errors import ConfigError, NewsError
from newsloom.lineage import checkpointed
from newsloom.operators import breaker, dedup, evict, metrics, normalize, registry, rules, schedule
from newsloom.plans import pipeline
from newsloom.plugins import Plugins
from newsloom.schema import ARTICLE
from newsloom.sources import documents, fetch, sinks


class Engine:
    """Crawls, and what they leave in store, a shared folder.

    read: feeds DataFrame to documents (feed_id, url, content, content_type, feed_type and, for those that could not be
    read, error). Without it feeds are fetched, behind their circuit breakers; fetching holds options of fetch.fetch().
    """

    def __init__(self, spark: SparkSession, read: Callable[[DataFrame], DataFrame] | None = None, feeds: DataFrame | None = None, config: Settings | None = None, store: str | None = None, fetching: dict | None = None) -> None:
        self.spark, self.read, self.config, self.fetching = spark, read, config or settings(), fetching or {}
        self.breakers = spark.createDataFrame([], breaker.STATE)
        self.feeds = registry.feeds(spark) if feeds is None else feeds
        self.plugins, self.began, self.store = Plugins(), time.time(), store
        self.schedule = schedule.of_registry(self.feeds, F.current_timestamp())
        self.checks = spark.createDataFrame([(n, "healthy") for n in metrics.CRITICAL], "name string, status string")

    def health(self) -> str:
        return metrics.health(self.checks).first()["status"]

    def ready(self) -> bool:
        return metrics.ready(self.checks).first()["ready"]

    def live(self) -> bool:
        return not self.spark.sparkContext._jsc.sc().isStopped()

    def info(self) -> dict:
        return {"name": self.config.app_name, "version": self.config.app_version, "environment": self.config.environment, "uptime_seconds": time.time() - self.began}

    def metrics(self) -> str:
        """Registry, jobs, articles and the dedup store as lines of text."""
        frames = {"feeds": registry.stats(self.feeds).withColumnsRenamed({"value": "of", "feeds": "value"})}
        if self.store is not None and self._exists("crawl_jobs"):
            frames["crawl_jobs"] = metrics.counters(self.spark.read.parquet(f"{self.store}/crawl_jobs"), "feed_id", "status")
            frames["articles"] = metrics.counters(self.spark.read.parquet(f"{self.store}/crawls"), "feed_id", "status")
            frames["rule_errors"] = metrics.counters(self.spark.read.parquet(f"{self.store}/data_validation_log"), "feed_id", "rule_id")
        known = self._known()
        if known is not None:
            frames["dedup_store"] = known.agg(F.count(F.lit(1)).alias("value"))
        lines = [r["line"] for name, frame in frames.items() for r in metrics.exposition(frame, name).collect()]
        return "\n".join(sorted(lines))

    def add_feed(self, feed: dict) -> None:
        self.feeds = registry.add(self.feeds, registry.feeds(self.spark, [feed]))

    def list_feeds(self) -> DataFrame:
        return self.feeds

    def get_feed(self, feed_id: str) -> dict:
        rows = registry.get(self.feeds, feed_id).collect()
        if not rows:
            raise NewsError(f"Feed {feed_id} not found", "FEED_NOT_FOUND")
        return rows[0].asDict()

    def delete_feed(self, feed_id: str) -> None:
        self.feeds = registry.remove(self.feeds, feed_id)

    def crawl(self, feed_id: str, as_of: Column | None = None) -> pipeline.Result:
        self.get_feed(feed_id)
        return self._crawl(registry.get(self.feeds, feed_id), as_of, feed_id)

    def crawl_all(self, as_of: Column | None = None) -> pipeline.Result:
        """One job over all enabled feeds; a feed that cannot be read or parsed is among the failures."""
        return self._crawl(registry.enabled(self.feeds), as_of, "all")

    def _read(self, feeds: DataFrame, as_of: Column) -> DataFrame:
        """Documents, read once: what comes after would else fetch them again."""
        if self.read is not None:
            return checkpointed(self.read(feeds))
        c = self.config
        given = {"retries": c.max_retries, "backoff": float(c.retry_backoff_seconds)} | self.fetching
        got = checkpointed(fetch.fetch(breaker.guarded(feeds, self.breakers, as_of), **given))
        self.breakers = checkpointed(breaker.after(self.breakers, got, as_of, c.circuit_breaker_failure_threshold, c.circuit_breaker_timeout_minutes))
        return got.join(feeds.select("feed_id", "feed_type"), "feed_id")

    def _crawl(self, feeds: DataFrame, as_of: Column | None, job_id: str) -> pipeline.Result:
        as_of = F.current_timestamp() if as_of is None else as_of
        docs = documents.dispatch(self._read(feeds, as_of))
        entries = documents.parse(docs, as_of)
        found = entries.filter("error IS NULL").drop("error")
        nothing = {c: ARTICLE[c].dataType for c in ("language", "raw_html", "article_id", "metadata")}
        # the order in which one crawl after the other would meet them
        arrival = F.struct("feed_id", "entry", "url").alias("arrival")
        articles = found.select("*", F.col("feed_id").alias("source"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], arrival).dropDuplicates(["feed_id", "entry", "url"])
        out = pipeline.run(articles.withColumn("article_key", F.concat_ws("#", "feed_id", "url")), as_of, job_id, self._known(), self.config.dedup_cache_size)
        out.failures = documents.failures(feeds, docs, entries)
        out.run_id = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        return out

    def _known(self, run: str | None = None) -> DataFrame | None:
        """The dedup store as the last finished crawl (before run) left it; None if there is none."""
        if self.store is None or not self._exists("dedup_store"):
            return None
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.store}/dedup_store")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        names = sorted(x.getPath().getName() for x in found)
        names = [n for n in names if n.startswith("run=") and (run is None or n < f"run={run}") and self._exists(f"dedup_store/{n}/_SUCCESS")]
        return self.spark.read.schema(evict.STORE).parquet(f"{self.store}/dedup_store/{names[-1]}") if names else None

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.store}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def complete(self, result: pipeline.Result, as_of: Column | None = None) -> DataFrame:
        """Publishes a crawl into the store: messages, dead letters, validation log, job rows and dedup store. Returns the job rows.

        The statuses are written first and all else comes from there. Everything lies in folders named by the run, so calling this
        again after a failure at any point decides nothing anew and leaves each row once.
        """
        if self.store is None:
            raise ConfigError("A store is needed to complete a crawl", field="store")
        as_of = F.current_timestamp() if as_of is None else as_of
        run = result.run_id
        if not self._exists(f"crawls/run={run}/_SUCCESS"):
            sinks.keep(result.status, "crawls", self.store, run)
        if not self._exists(f"crawl_failures/run={run}/_SUCCESS"):
            sinks.keep(result.failures, "crawl_failures", self.store, run)
        status, failures = self.spark.read.parquet(f"{self.store}/crawls/run={run}"), self.spark.read.parquet(f"{self.store}/crawl_failures/run={run}")
        job = status.agg(F.first("job_id")).first()[0] or "all"
        published = status.filter("status = 'published'")
        sinks.publish(normalize.messages(published, as_of, job), sinks.MESSAGES, self.store, run)
        refused = status.filter("status IN ('invalid', 'error')")
        letters = sinks.dead_letters(refused.select("feed_id", "url", "title", "body", "errors"), F.coalesce(F.nullif(F.array_join("errors", "; "), F.lit("")), F.lit("NORMALIZATION_ERROR")), as_of, ("feed_id", "url", "title", "body"))
        lost = sinks.dead_letters(failures.join(self.feeds.select("feed_id", "url"), "feed_id", "left"), F.col("error"), as_of, ("feed_id", "url"))
        sinks.keep(letters.unionByName(lost), sinks.DEAD_LETTERS.name, self.store, run)
        sinks.keep(rules.validation_log(refused, as_of), "data_validation_log", self.store, run)
        rows = metrics.job_rows(status, as_of, failures, job)
        sinks.keep(rows, "crawl_jobs", self.store, run)
        # last: until this is there, the articles count as not yet published
        signed = dedup.signatures(published.select("arrival", "title", "body"))
        sinks.keep(evict.store_after(signed, self.config.dedup_cache_size, store=self._known(run)), "dedup_store", self.store, run)
        return self.spark.read.parquet(f"{self.store}/crawl_jobs/run={run}")

    def bundle(self) -> dict:
        """Health, dedup store, registry and schedule figures."""
        known = self._known()
        return {
            "health": metrics.report(self.checks).first().asDict(True), "dedup_store": dedup.cache_stats(known if known is not None else self.spark.createDataFrame([], evict.STORE), self.config.dedup_cache_size).first().asDict(),
            "feed_registry": [r.asDict() for r in registry.stats(self.feeds).collect()], "scheduler": [r.asDict() for r in schedule.stats(self.schedule).collect()],
        }
