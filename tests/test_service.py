"""Endpoints, plugins and proxies."""

import json

import pytest
from pyspark.sql import functions as F

from newsloom.engine import Engine
from newsloom.errors import ConfigError, NewsError
from newsloom.operators import registry
from newsloom.plugins import Kind, Metadata, Plugin, Plugins, RotatingProxies, SocketSource, Summarizer
from newsloom.sources.fetch import Proxy, ProxyPool


def test_endpoints(spark):
    engine = Engine(spark, lambda feeds: None, registry.feeds(spark, [{"feed_id": "a", "name": "A", "url": "https://a.example", "country": "US"}]))
    assert (engine.health(), engine.ready(), engine.live()) == ("healthy", True, True)
    info = engine.info()
    assert info["name"] == "newsloom" and info["uptime_seconds"] >= 0 and info["environment"] in ("development", "staging", "production")
    engine.add_feed({"feed_id": "b", "name": "B", "url": "https://b.example", "headers": {"X": "y"}, "enabled": False})
    assert sorted(r.feed_id for r in engine.list_feeds().collect()) == ["a", "b"]
    assert engine.get_feed("b")["headers"] == {"X": "y"} and engine.get_feed("b")["crawl_interval_minutes"] == 30
    with pytest.raises(NewsError, match="DUPLICATE_FEED"):
        engine.add_feed({"feed_id": "a", "name": "again", "url": "u"})
    lines = engine.metrics().split("\n")
    assert 'feeds{dimension="all",of="total"} 2' in lines and 'feeds{dimension="all",of="enabled"} 1' in lines
    engine.delete_feed("a")
    for lost in (lambda: engine.get_feed("a"), lambda: engine.delete_feed("a"), lambda: engine.crawl("a")):
        with pytest.raises(NewsError, match="FEED_NOT_FOUND"):
            lost()
    engine.checks = spark.createDataFrame([("database", "unhealthy"), ("proxy", "degraded")], "name string, status string")
    assert (engine.health(), engine.ready()) == ("unhealthy", False)


class Shouting(Plugin):
    metadata = Metadata("shouting", "2.1", Kind.TRANSFORMER, dependencies=("summarizer",))
    required = ("mark",)

    def apply(self, df):
        return df.withColumn("title", F.concat(F.upper("title"), F.lit(self.config["mark"])))


def test_plugins(spark):
    plugins = Plugins()
    with pytest.raises(ConfigError, match="mark"):
        plugins.load(Shouting())
    assert plugins.names() == []
    loud = plugins.load(Shouting({"mark": "!"}))
    plugins.load(Summarizer({"endpoint": "local", "model": "m"}))
    with pytest.raises(NewsError, match="PLUGIN_EXISTS"):
        plugins.load(Shouting({"mark": "?"}))
    rows = spark.createDataFrame([("one", "text"), ("two", None)], "title string, body string")
    for p in plugins.loaded.values():
        rows = p.apply(rows)
    assert sorted(map(tuple, rows.collect()), key=repr) == [("ONE!", "text", "Summary of: ONE!", "m"), ("TWO!", None, None, None)]
    assert plugins.of(Kind.TRANSFORMER) == [loud] and [m.version for m in plugins.metadata()] == ["2.1", "1.0.0"] and plugins.health() == {"shouting": True, "summarizer": True}
    plugins.reload("shouting", {"mark": "?"})
    assert plugins.get("shouting").config == {"mark": "?"}
    plugins.unload("shouting")
    assert not loud.healthy() and plugins.names() == ["summarizer"]
    with pytest.raises(NewsError, match="PLUGIN_NOT_FOUND"):
        plugins.unload("shouting")
    plugins.shutdown()
    assert plugins.names() == []
    with pytest.raises(ConfigError):
        Metadata("", "1")
    feeds = spark.createDataFrame([("a", "wss://x", "websocket"), ("b", "http://x", "rss"), ("c", "https://x", "rss")], "feed_id string, url string, feed_type string")
    assert [r.feed_id for r in SocketSource({"websocket_urls": []}).accepts(feeds).collect()] == ["a"]
    assert [r.feed_id for r in RotatingProxies({"proxies": []}).accepts(feeds).orderBy("feed_id").collect()] == ["b", "c"]


def test_proxy_pool():
    pool = ProxyPool([Proxy("a:1"), Proxy("https://b:2"), Proxy("c:3", "https")], seed=5)
    assert [pool.next().address() for _ in range(4)] == ["http://a:1", "https://b:2", "https://c:3", "http://a:1"]
    pool.mark_failed(Proxy("https://b:2"))
    assert [pool.next().address() for _ in range(3)] == ["https://c:3", "http://a:1", "https://c:3"]
    assert {pool.random().address() for _ in range(40)} == {"http://a:1", "https://c:3"}
    assert pool.stats() == {"total": 3, "failed": 1, "available": 2}
    for p in (Proxy("a:1"), Proxy("c:3", "https")):
        pool.mark_failed(p)
    assert pool.stats()["available"] == 0 and pool.random() is not None and pool.stats()["failed"] == 0  # when all have failed, all are tried anew
    pool.mark_failed(Proxy("a:1"))
    pool.reset()
    assert pool.stats()["failed"] == 0
    pool.refresh([Proxy("d:4")])
    assert pool.next().address() == "http://d:4" and pool.stats() == {"total": 1, "failed": 0, "available": 1}
    empty = ProxyPool([])
    assert empty.next() is None and empty.random() is None


def test_registry_json_round_trip(spark):
    one = registry.feeds(spark, [{"feed_id": "a", "name": "A", "url": "https://a.example", "headers": {"k": "v"}}])
    text = registry.export_json(one).first().feeds
    back = registry.load_json(registry.feeds(spark, [{"feed_id": "b", "name": "B", "url": "u"}]), text)
    assert back.filter("feed_id = 'a'").first().asDict() == one.first().asDict() and json.loads(text)[0]["headers"] == {"k": "v"}
