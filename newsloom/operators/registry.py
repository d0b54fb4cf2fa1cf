"""The feed registry as a DataFrame: filters, changes, import and export, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.errors import NewsError
from newsloom.schema import FEED

#: feed_id, name, url, language, country of the default feeds.
DEFAULT_FEEDS = [
    ("cnn", "CNN", "http://rss.cnn.com/rss/edition.rss", "en", "US"),
    ("bbc", "BBC News", "https://feeds.bbci.co.uk/news/rss.xml", "en", "GB"),
    ("reuters", "Reuters (via Guardian)", "https://www.theguardian.com/world/rss", "en", "GB"),
    ("aljazeera", "Al Jazeera", "http://www.aljazeera.com/xml/rss/all.xml", "en", "QA"),
    ("xinhua", "Xinhua News", "http://www.xinhuanet.com/english/rss/worldrss.xml", "zh", "CN"),
    ("rt", "RT News", "https://www.rt.com/rss/", "ru", "RU"),
    ("tasnim", "Tasnim News Agency", "https://www.tasnimnews.com/en/rss/feed/0/0/0/0/AllStories", "fa", "IR"),
    ("isna", "IRNA News Agency", "https://en.irna.ir/rss", "fa", "IR"),
]
#: The bulk client's own addresses where they differ.
BULK_URLS = {
    "bbc": "http://feeds.bbc.co.uk/news/rss.xml",
    "reuters": "http://feeds.reuters.com/reuters/topNews",
    "xinhua": "http://www.xinhuanet.com/english/rss.xml",
    "rt": "http://rt.com/rss/",
    "tasnim": "http://www.tasnimnews.com/rss/feed/0/en",
    "isna": "http://isna.ir/en/rss",
}


def feeds(spark: SparkSession, rows: list[dict] | None = None) -> DataFrame:
    """Rows of FEED with defaults; the default feeds if none are given."""
    if rows is None:
        rows = [{"feed_id": i, "name": n, "url": u, "language": la, "country": c, "timeout_seconds": 15} for i, n, u, la, c in DEFAULT_FEEDS]
    base = {"feed_type": "rss", "enabled": True, "crawl_interval_minutes": 30, "timeout_seconds": 10, "headers": {}, "metadata": {}}
    return spark.createDataFrame([tuple((base | r).get(f.name) for f in FEED.fields) for r in rows], FEED)


def bulk_feeds(spark: SparkSession) -> DataFrame:
    return feeds(spark, [{"feed_id": i, "name": n, "url": BULK_URLS.get(i, u), "language": la, "country": c} for i, n, u, la, c in DEFAULT_FEEDS])


def register(registry: DataFrame, more: DataFrame) -> DataFrame:
    """Feeds whose id is new are added; known ids keep their row."""
    return registry.unionByName(more.dropDuplicates(["feed_id"]).join(registry.select("feed_id"), "feed_id", "left_anti"))


def enabled(registry: DataFrame) -> DataFrame:
    return registry.filter("enabled")


def by(registry: DataFrame, column: str, value: str) -> DataFrame:
    """country, language or feed_type, whatever the case; null never matches."""
    return registry.filter(F.lower(column) == value.lower())


def _one(registry: DataFrame, feed_id: str) -> None:
    if not registry.filter(F.col("feed_id") == feed_id).limit(1).count():
        raise NewsError(f"Feed {feed_id} not found", "FEED_NOT_FOUND")


def get(registry: DataFrame, feed_id: str) -> DataFrame:
    return registry.filter(F.col("feed_id") == feed_id)


def add(registry: DataFrame, feed: DataFrame) -> DataFrame:
    known = feed.join(registry.select("feed_id"), "feed_id", "left_semi").limit(1).collect()
    if known:
        raise NewsError(f"Feed {known[0]['feed_id']} already exists", "DUPLICATE_FEED")
    return registry.unionByName(feed)


def remove(registry: DataFrame, feed_id: str) -> DataFrame:
    _one(registry, feed_id)
    return registry.filter(F.col("feed_id") != feed_id)


def update(registry: DataFrame, feed_id: str, **changes) -> DataFrame:
    """Fields that a feed does not have are ignored."""
    _one(registry, feed_id)
    mine = F.col("feed_id") == feed_id

    def value(name: str, kind) -> Column:
        x = changes[name]
        return (F.create_map(*[F.lit(y) for kv in x.items() for y in kv]) if isinstance(x, dict) else F.lit(x)).cast(kind)

    return registry.select(*[F.when(mine, value(f.name, f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in changes and f.name != "feed_id" else F.col(f.name) for f in FEED.fields])


def set_enabled(registry: DataFrame, feed_id: str, on: bool) -> DataFrame:
    return update(registry, feed_id, enabled=on)


def load_json(registry: DataFrame, text: str) -> DataFrame:
    """Adds the feeds of a JSON array; what is no array of feeds, or an id twice, is an error."""
    spark = registry.sparkSession
    rows = spark.createDataFrame([(text,)], "j string").select(F.from_json("j", f"array<{FEED.simpleString()}>").alias("f"))
    found = rows.select(F.inline("f"))
    bad = found.filter("feed_id IS NULL OR name IS NULL OR url IS NULL").limit(1).count()
    if not text.strip().startswith("[") or bad or rows.filter("f IS NULL").count():
        raise NewsError("Not an array of feeds", "LOAD_FAILED")
    if found.groupBy("feed_id").count().filter("count > 1").limit(1).count() or found.join(registry, "feed_id", "left_semi").limit(1).count():
        raise NewsError("A feed id is there twice", "LOAD_FAILED")
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    defaults = {"feed_type": F.lit("rss"), "enabled": F.lit(True), "crawl_interval_minutes": F.lit(30), "timeout_seconds": F.lit(10), "headers": empty, "metadata": empty}
    return registry.unionByName(found.select(*[F.coalesce(F.col(f.name), defaults[f.name]).alias(f.name) if f.name in defaults else F.col(f.name) for f in FEED.fields]))


def export_json(registry: DataFrame) -> DataFrame:
    """One row: the registry as a JSON array by feed_id. The registry is small by nature."""
    row = F.struct(*[F.col(f.name) for f in FEED.fields])
    by_id = lambda a, b: F.when(a["feed_id"] < b["feed_id"], -1).when(a["feed_id"] > b["feed_id"], 1).otherwise(0)  # noqa: E731  maps have no order
    return registry.agg(F.to_json(F.array_sort(F.collect_list(row), by_id), {"ignoreNullFields": "false"}).alias("feeds"))


def stats(registry: DataFrame) -> DataFrame:
    """dimension, value, feeds: totals, and counts by type, country and language, blanks left out."""
    totals = registry.select(F.explode(F.array(F.lit("total"), F.when(F.col("enabled"), "enabled").otherwise("disabled"))).alias("value")).select(F.lit("all").alias("dimension"), "value")
    parts = registry.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("feed_type", "country", "language")])).alias("p")).select("p.*")
    return totals.unionByName(parts.filter("value <> ''")).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("feeds"))


def due(registry: DataFrame, last: DataFrame, as_of: Column) -> DataFrame:
    """Enabled feeds whose interval has passed since last(feed_id, last_crawled_at); never crawled is due."""
    seen = registry.filter("enabled").join(last, "feed_id", "left")
    at = F.col("last_crawled_at") + F.make_dt_interval(mins=F.col("crawl_interval_minutes"))
    return seen.filter(F.col("last_crawled_at").isNull() | (at <= as_of)).select("feed_id", "last_crawled_at")
