"""Registry, parsers, fetching, schedule, logging and whole crawls on literal rows."""

import io
import json
import logging
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom import logs
from newsloom.config import Settings
from newsloom.engine import Engine
from newsloom.errors import NewsError, ParseError
from newsloom.operators import breaker, registry, schedule
from newsloom.sources import documents, fetch, sinks

NOW = datetime(2024, 2, 1)
PROSE = "The council said on Monday that the bridge will be closed for the repair of its piers, and that it is to open again in the spring. "
RSS = """<rss version="2.0"><channel><title>N</title>
<item><title>Bridge closed for repairs</title><link>https://n.example/a?utm_source=x</link><description>{0}</description><author>Ann Lee</author><pubDate>Mon, 15 Jan 2024 10:30:00 GMT</pubDate></item>
<item><title><![CDATA[Bridge closed for repairs]]></title><link>https://n.example/b</link><description>{0}</description></item>
<item><title>Sun</title><link>https://n.example/c</link><description>short</description></item>
<item><link>https://n.example/d</link><description>no title</description></item></channel></rss>""".format(PROSE * 2)
ATOM = f"""<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A museum opens in the old mill</title><link rel="self" href="https://m.example/self"/><link href="https://m.example/1"/><summary>{"It is the first of the new rooms that the town has for the history of the mill and of those who were at work in it. " * 2}</summary><published>2024-01-20T08:00:00Z</published><author><name>Bo Dahl</name></author></entry></feed>"""
PAGE = f"""<html><head><title>Harbour plan</title><meta content="Cy Wood" name="author"><meta property="article:published_time" content="2024-01-10T06:00:00Z"></head><body><nav>Menu</nav><article><p>{"They have a plan for the harbour, and it is to be the work of this year and the next at the docks by the river. " * 2}</p></article><script>x()</script></body></html>"""


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "feed_id string, url string, content string, content_type string, feed_type string")


def test_rss_atom_and_errors(spark):
    d = docs(spark, ("r", "u", RSS, "text/xml", None), ("a", "u", ATOM, "application/atom+xml", None), ("e", "u", "<rss><channel></channel></rss>", "text/xml", None), ("v", "u", "<rss><channel><item><title>x</title></item></channel></rss>", "text/xml", None))
    got = documents.feed_entries(documents.dispatch(d), now())
    rows = {(r.feed_id, r.entry): r for r in got.collect()}
    assert rows["r", 0].author == "Ann Lee" and rows["r", 0].published_at == datetime(2024, 1, 15, 10, 30) and rows["r", 1].title == "Bridge closed for repairs"
    assert rows["r", 1].published_at == NOW and rows["r", 3].error == "RSS_BAD_ENTRY"
    assert (rows["a", 0].url, rows["a", 0].author, rows["a", 0].published_at) == ("https://m.example/1", "Bo Dahl", datetime(2024, 1, 20, 8))
    assert {r.feed_id: r.error for r in documents.feed_errors(got).collect()} == {"e": "RSS_NO_ENTRIES", "v": "RSS_NO_VALID_ARTICLES"}


def test_page(spark):
    d = spark.createDataFrame([("p", "https://h.example/x?utm_medium=y", PAGE), ("q", "u", "<html><body><p class='byline'>By Di Fox</p><time datetime=2024-01-11>x</time></body></html>"), ("z", "u", "")], "feed_id string, url string, html string")
    got = {r.feed_id: r for r in documents.page_articles(d, now()).collect()}
    p = got["p"]
    assert (p.title, p.author, p.published_at, p.extraction_method, p.error) == ("Harbour plan", "Cy Wood", datetime(2024, 1, 10, 6), "marked", None)
    assert "Menu" not in p.body and "x()" not in p.body
    assert (got["q"].author, got["q"].published_at, got["q"].error) == ("Di Fox", datetime(2024, 1, 11), "HTML_EXTRACTION_FAILED")
    assert got["z"].error == "HTML_EXTRACTION_FAILED"


def test_custom_parser(spark):
    def lines(d, as_of):
        return d.select("feed_id", F.split("content", "\n")[0].alias("title"), F.col("content").alias("body"), "url", F.col("url").alias("canonical_url"), as_of.alias("published_at"), F.lit("me").alias("author"), F.lit("lines").alias("extraction_method"), F.lit(None).cast("string").alias("error"))

    documents.register_parser("Lines", lines)
    try:
        assert documents.parsers() == ["rss", "html", "lines"]
        got = documents.parse(documents.dispatch(docs(spark, ("t", "u", "One\ntwo", "text/plain", "LINES"), ("r", "u", RSS, "text/xml", None), ("x", "u", "?", "text/plain", None))), now())
        assert {(r.feed_id, r.extraction_method) for r in got.collect()} == {("t", "lines"), ("r", "rss")}
    finally:
        documents.unregister_parser("lines")
    with pytest.raises(ParseError):
        documents.register_parser("no", None)


def test_fetch_and_breaker(spark):
    def read(url, timeout, proxy):
        if "bad" in url:
            raise OSError("down")
        return (302 if "moved" in url else 404 if "gone" in url else 200), "text/html", b"x\x80"

    feeds = spark.createDataFrame([(i, f"https://{i}.example", 5) for i in ("ok", "bad", "moved", "gone")], "feed_id string, url string, timeout_seconds int")
    state, shut = spark.createDataFrame([("ok", 2, None)], breaker.STATE), None
    for call in range(4):
        at = F.lit(NOW + timedelta(minutes=call))
        got = fetch.fetch(breaker.guarded(feeds, state, at), retries=1, read=read, sleep=lambda s: None)
        rows = {r.feed_id: r for r in got.collect()}
        state = spark.createDataFrame(breaker.after(state, got, at).collect(), breaker.STATE)
        shut = {r.feed_id: (r.failures, r.open_until) for r in state.collect()}
        assert rows["ok"].error is None and rows["ok"].content == "x�" and shut["ok"] == (0, None)
        assert rows["bad"].error == ("CIRCUIT_BREAKER_OPEN" if call == 3 else "FETCH_FAILED") and rows["bad"].attempts == (0 if call == 3 else 2)
        if call < 3:
            assert {k: r.last_error for k, r in rows.items()} == {"ok": None, "bad": "FETCH_ERROR", "moved": "HTTP_REDIRECT", "gone": "HTTP_ERROR"}
    assert shut["bad"] == (3, NOW + timedelta(minutes=12))


def test_schedule(spark):
    s = schedule.of_registry(registry.feeds(spark), now()).filter("feed_id IN ('bbc', 'cnn')")
    s = schedule.add(schedule.add(s, "mine", 5, now()), "bbc", 60, now())
    s = schedule.pause(s, "cnn")
    due = lambda minutes: {r.feed_id for r in schedule.due(s, F.lit(NOW + timedelta(minutes=minutes))).collect()}
    assert due(4) == set() and due(5) == {"mine"} and due(60) == {"mine", "bbc"}
    s = schedule.trigger(schedule.resume(s, "cnn", now()), "bbc", now())
    assert due(0) == {"bbc"}
    s = schedule.ran(s, schedule.due(s, now()), now())
    assert due(0) == set() and due(60) == {"bbc", "cnn", "mine"}
    s = schedule.remove(schedule.remove(s, "mine"), "unknown")
    assert {r.feed_id: (r.name, r.next_run_time, r.trigger, r.paused) for r in schedule.stats(schedule.pause(s, "cnn")).collect()} == {"bbc": ("Crawl bbc", "2024-02-01T01:00:00", "every 60 minutes", False), "cnn": ("Crawl cnn", None, "every 30 minutes", True)}


def test_registry(spark):
    r = registry.feeds(spark, [{"feed_id": "a", "name": "A", "url": "https://a.example", "country": "US", "language": "en"}, {"feed_id": "b", "name": "B", "url": "https://b.example", "country": "FR", "language": "fr", "enabled": False}])
    with pytest.raises(NewsError, match="DUPLICATE_FEED"):
        registry.add(r, registry.feeds(spark, [{"feed_id": "a", "name": "x", "url": "y"}]))
    for change in (lambda: registry.remove(r, "zz"), lambda: registry.update(r, "zz", name="n")):
        with pytest.raises(NewsError, match="FEED_NOT_FOUND"):
            change()
    u = registry.update(r, "a", name="New", headers={"k": "v"}, unknown=1)
    assert registry.get(u, "a").first().name == "New" and registry.get(u, "a").first().headers == {"k": "v"}
    more = registry.load_json(r, '[{"feed_id": "c", "name": "C", "url": "https://c.example"}]')
    assert sorted(f["feed_id"] for f in json.loads(registry.export_json(more).first().feeds)) == ["a", "b", "c"]
    assert registry.get(more, "c").first().crawl_interval_minutes == 30
    for bad in ("{}", "[1]", '[{"feed_id": "a", "name": "A", "url": "u"}]'):
        with pytest.raises(NewsError, match="LOAD_FAILED"):
            registry.load_json(r, bad)
    assert [x.feed_id for x in registry.enabled(r).collect()] == ["a"]


def test_crawl_to_completion(spark, tmp_path):
    def read(feeds):
        found = docs(spark, ("bbc", "https://n.example", RSS, "text/xml", None), ("cnn", "https://m.example", ATOM, "application/xml", None), ("rt", "https://h.example/x", PAGE, "text/html", "html"))
        return found.join(feeds.select("feed_id"), "feed_id", "left_semi")

    engine = Engine(spark, read, store=str(tmp_path))
    assert engine.health() == "healthy" and engine.ready() and engine.live()
    assert sinks.ensure_topics(spark, engine.store) == {"news_raw": True, "news_raw_dlq": True} and all(sinks.verify_topics(spark, engine.store).values()) and sinks.sink_health(spark, engine.store)
    assert sinks.describe_topic(sinks.MESSAGES)["retention.ms"] == str(30 * 86_400_000)
    jobs = {r.feed_id: r for r in engine.complete(engine.crawl_all(now()), now()).collect()}
    assert {r.status for k, r in jobs.items() if k not in ("bbc", "cnn", "rt")} == {"failed"}  # nothing was read of them
    assert {k: (r.articles_crawled, r.articles_published, r.articles_failed, r.status) for k, r in jobs.items() if r.status == "completed"} == {"bbc": (2, 1, 1, "completed"), "cnn": (1, 1, 0, "completed"), "rt": (1, 1, 0, "completed")}
    sent = [json.loads(r.value) for r in spark.read.parquet(f"{tmp_path}/news_raw").collect()]
    assert {(m["source"], m["canonical_url"], m["author"], m["language"]) for m in sent} == {("bbc", "https://n.example/a", "Ann Lee", "en"), ("cnn", "https://m.example/1", "Bo Dahl", "en"), ("rt", "https://h.example/x", "Cy Wood", "en")}
    dead = spark.read.parquet(f"{tmp_path}/news_raw_dlq").collect()
    dead = {json.loads(r.original_message)["feed_id"]: r for r in dead}
    assert json.loads(dead.pop("bbc").original_message)["title"] == "Sun" and {r.error for r in dead.values()} == {"NO_DOCUMENT"}
    assert spark.read.parquet(f"{tmp_path}/data_validation_log").count() >= 1
    # what was published is known to the next crawl
    again = {r.feed_id: r for r in engine.complete(engine.crawl("bbc", now()), now()).collect()}
    assert (again["bbc"].articles_crawled, again["bbc"].articles_published) == (2, 0)
    assert spark.read.parquet(f"{tmp_path}/news_raw").count() == 3 and spark.read.parquet(f"{tmp_path}/crawl_jobs").count() == 9
    bundle = engine.bundle()
    assert bundle["health"]["status"] == "healthy" and bundle["dedup_store"]["size"] == 3 and len(bundle["scheduler"]) == 8
    with pytest.raises(NewsError, match="FEED_NOT_FOUND"):
        engine.crawl("nobody")


def fleet(spark):
    names = ("good", "down", "broken", "odd", "empty")
    return registry.feeds(spark, [{"feed_id": n, "name": n, "url": f"https://{n}.example", "feed_type": "wat" if n == "odd" else "rss"} for n in names])


def answer(url, timeout, proxy):
    if "down" in url:
        raise OSError("no route")
    body = {"good": RSS, "broken": "<rss><channel><item><title>", "odd": "?", "empty": "<rss><channel></channel></rss>"}[url.split("//")[1].split(".")[0]]
    return 200, "application/octet-stream" if "odd" in url else "text/xml", body.encode()


def test_failed_feeds_have_jobs(spark, tmp_path):
    config = Settings(circuit_breaker_failure_threshold=1)
    engine = Engine(spark, feeds=fleet(spark), config=config, store=str(tmp_path), fetching={"read": answer, "retries": 0, "sleep": lambda s: None})
    for call in range(2):
        at = F.lit(NOW + timedelta(minutes=call))
        jobs = {r.feed_id: (r.status, r.articles_crawled, r.articles_published, r.errors) for r in engine.complete(engine.crawl_all(at), at).collect()}
        assert {k: v[3] for k, v in jobs.items() if v[0] == "failed"} == {
            "down": ["CIRCUIT_BREAKER_OPEN" if call else "FETCH_FAILED"], "broken": ["RSS_NO_ENTRIES"], "odd": ["PARSER_UNKNOWN"], "empty": ["RSS_NO_ENTRIES"],
        }
        assert jobs["good"][:3] == ("completed", 2, 0 if call else 1)
    dead = {(json.loads(r.original_message)["feed_id"], r.error) for r in spark.read.parquet(f"{tmp_path}/news_raw_dlq").collect()}
    assert {("down", "FETCH_FAILED"), ("down", "CIRCUIT_BREAKER_OPEN"), ("odd", "PARSER_UNKNOWN")} <= dead
    lines = engine.metrics().split("\n")
    assert 'crawl_jobs{feed_id="down",status="failed"} 2' in lines and 'articles{feed_id="good",status="published"} 1' in lines and "dedup_store 1" in lines


def test_breaker_closes_after_its_time(spark):
    state = spark.createDataFrame([("x", 5, NOW), ("y", 5, NOW + timedelta(minutes=5))], breaker.STATE)
    at = F.lit(NOW + timedelta(minutes=1))
    asked = {r.feed_id: r.circuit_open for r in breaker.guarded(state.select("feed_id"), state, at).collect()}
    assert asked == {"x": False, "y": True}
    failed = spark.createDataFrame([("x", "FETCH_FAILED"), ("y", "CIRCUIT_BREAKER_OPEN")], "feed_id string, error string")
    assert {r.feed_id: (r.failures, r.open_until) for r in breaker.after(state, failed, at).collect()} == {"x": (1, None), "y": (5, NOW + timedelta(minutes=5))}


def test_a_killed_crawl_is_completed_once(spark, tmp_path, monkeypatch):
    from newsloom.operators import evict

    def read(feeds):
        return docs(spark, ("bbc", "https://n.example", RSS, "text/xml", None), ("cnn", "https://m.example", ATOM, "application/xml", None))

    def killed(*a, **k):
        raise RuntimeError("killed")

    engine = Engine(spark, read, registry.feeds(spark).filter("feed_id IN ('bbc', 'cnn', 'rt')"), store=str(tmp_path))
    result = engine.crawl_all(now())
    for where, step in ((sinks, "dead_letters"), (evict, "store_after")):
        with monkeypatch.context() as m:
            m.setattr(where, step, killed)
            with pytest.raises(RuntimeError):
                engine.complete(result, now())
    for _ in range(2):
        jobs = {r.feed_id: (r.status, r.errors) for r in engine.complete(result, now()).collect()}
    assert jobs["rt"] == ("failed", ["NO_DOCUMENT"]) and jobs["cnn"] == ("completed", [])
    tables = {n: spark.read.parquet(f"{tmp_path}/{n}").count() for n in ("news_raw", "news_raw_dlq", "crawl_jobs", "dedup_store")}
    assert tables == {"news_raw": 2, "news_raw_dlq": 2, "crawl_jobs": 3, "dedup_store": 2}


def test_json_logs():
    out = io.StringIO()
    log = logs.configure("debug", out)
    logs.set_trace_id("t1")
    log.info("read %s", "é", extra={"feed_id": "bbc"})
    try:
        raise ValueError("x")
    except ValueError:
        log.exception("failed")
    first, second = map(json.loads, out.getvalue().splitlines())
    assert (first["message"], first["level"], first["trace_id"], first["feed_id"]) == ("read é", "INFO", "t1", "bbc")
    assert "ValueError: x" in second["exception"]
    logs.set_trace_id(None)
    assert logs.trace_id() == logs.trace_id()
    logging.getLogger("newsloom").handlers.clear()
