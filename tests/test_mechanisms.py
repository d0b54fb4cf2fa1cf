"""Delivery of streams, sites as a data source, catalog tables, as-of joins, the language model and the densest stretch."""

import http.server
import json
import os
import random
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.errors import SchemaError
from newsloom.operators.asof import asof_join
from newsloom.operators.langmodel import LanguageModel
from newsloom.sources import catalog, documents, sites, stretch
from newsloom.streaming.delivery import Producer, partition_of

SF = "/root/testdata/sf0.1"


def test_producer(spark, tmp_path):
    rows = [(f"k{i}", "v" * i, i % 3 != 0 if i % 7 else None, "BAD") for i in range(60)]
    schema = "key string, value string, good boolean, error string"
    frame = spark.createDataFrame(rows, schema)
    frame.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    producer = Producer(str(tmp_path))
    producer.start(stream)
    producer.flush()
    # a batch that is run again replaces its own rows
    first = spark.createDataFrame(rows[:1], schema).limit(0).withColumn("partition", F.lit(0).cast("long"))
    producer.stop()
    good = [r for r in rows if r[2]]
    parts = {r.key: r.p for r in frame.select("key", partition_of(F.col("key"), 6).alias("p")).collect()}
    want = {i: (sum(parts[k] == i for k, *_ in good), max((len(v) for k, v, *_ in good if parts[k] == i), default=None)) for i in range(6)}
    assert {r.partition: (r.delivered, r.largest) for r in producer.report(spark).collect()} == want and producer.refused() == len(rows) - len(good)
    sent = lambda: sorted(r.key for r in spark.read.parquet(f"{tmp_path}/news_raw").collect())
    assert sent() == sorted(r[0] for r in good) and spark.read.parquet(f"{tmp_path}/news_raw_dlq").count() == len(rows) - len(good)
    number = max(producer.listener.batches)
    again = spark.read.parquet(f"{tmp_path}/staged/batch={number}").select(*first.columns)
    producer._batch(spark.createDataFrame(again.collect(), first.schema), number)
    assert sent() == sorted(r[0] for r in good)


def test_sites_over_http(spark):
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_GET(self):  # noqa: N802
            seen.append((self.client_address, self.path, self.headers["X-Key"]))
            body = f"<p>{self.path}é".encode()
            self.send_response(404 if "gone" in self.path else 200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        sites.register(spark)
        at = f"127.0.0.1:{server.server_port}"
        urls = [f"http://{at}/a?x=1", f"http://{at}/gone", f"http://{at}/c", "http://127.0.0.1:9/down"]
        load = lambda: spark.read.format("newsloom_sites").option("urls", json.dumps(urls)).option("headers", '{"X-Key": "k"}').option("timeout", "5").load()
        got = {r.url: (r.host, r.status, r.content_type, r.content) for r in load().collect()}
        assert got == {urls[0]: (at, 200, "text/html", "<p>/a?x=1é"), urls[1]: (at, 404, "text/html", "<p>/goneé"), urls[2]: (at, 200, "text/html", "<p>/cé"), urls[3]: ("127.0.0.1:9", None, None, None)}
        assert len({s[0] for s in seen}) == 1 and {s[2] for s in seen} == {"k"}  # one connection
        seen.clear()
        assert load().filter("host = '127.0.0.1:9'").count() == 1 and not seen  # the other host was not opened
    finally:
        server.shutdown()


def test_sites_filters():
    reader = sites.SitesReader({"urls": json.dumps([f"http://{h}/{i}" for h in ("a.x", "b.x", "m.a", "m.b") for i in range(2)])})
    eq, among, begins, other = sites.EqualTo(("host",), "m.a"), sites.In(("host",), ("m.a", "a.x")), sites.StringStartsWith(("host",), "m."), sites.EqualTo(("url",), "u")
    assert list(reader.pushFilters([begins, other])) == [other] and [p.host for p in reader.partitions()] == ["m.a", "m.b"]
    assert list(reader.pushFilters([among])) == [] and [(p.host, len(p.items)) for p in reader.partitions()] == [("m.a", 2)]
    assert list(reader.pushFilters([eq])) == [] and [p.host for p in reader.partitions()] == ["m.a"]


def test_catalog(spark, tmp_path):
    name = f"t_{os.getpid()}"
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y")], "id long, text string, kind string")
    assert catalog.create(spark, name, rows.schema, ("kind",), str(tmp_path / "t")) and not catalog.create(spark, name, rows.schema)
    try:
        catalog.load(rows, name)
        catalog.load(rows, name)
        assert catalog.rows_known(spark, name) == 3
        catalog.load(spark.createDataFrame([("z", 9, "x")], "text string, id long, kind string"), name)
        found = catalog.ask(spark, f"SELECT id, kind FROM {name} WHERE kind = :kind", kind="x")
        assert [tuple(r) for r in found.collect()] == [(9, "x")] and spark.table(name).count() == 2 and catalog.rows_known(spark, name) == 2
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(kind" in plan
        assert catalog.ask(spark, f"SELECT id FROM {name} WHERE kind = :kind", kind="x' OR '1' = '1").count() == 0
        with pytest.raises(SchemaError, match="kind"):
            catalog.load(rows.drop("kind"), name)
    finally:
        spark.sql(f"DROP TABLE {name}")
    assert catalog.healthy(spark)
    made = catalog.create_all(spark, root=str(tmp_path))
    try:
        assert set(made) == set(catalog.status(spark)) and all(catalog.status(spark).values()) and catalog.create_all(spark) == []
    finally:
        for table in made:
            spark.sql(f"DROP TABLE {table}")


@pytest.mark.parametrize("span", [86_400_000_000, 7_000_000])
def test_asof(spark, span):
    random.seed(4)
    at = lambda: datetime(2024, 1, 1) + timedelta(seconds=random.randrange(60))
    left = [(i, random.choice([1, 2, 3, None]), at() if i % 9 else None) for i in range(80)]
    right = [(random.choice([1, 2, None]), 100 + i, at(), "v%d" % i) for i in range(40)]
    got = asof_join(spark.createDataFrame(left, "id long, k long, ts timestamp"), spark.createDataFrame(right, "k long, n long, ts timestamp, id string"), "k", "ts", "n", span)
    want = {}
    for i, k, ts in left:
        able = [r for r in right if k is not None and ts is not None and r[0] == k and r[2] <= ts]
        want[i] = max(able, key=lambda r: (r[2], r[1])) if able else None
    assert {r.id: tuple(r.right_row) if r.right_row else None for r in got.collect()} == want
    assert got.limit(0).count() == 0


def test_language_model(spark):
    texts = {"en": "the house of the old man and the sea was on the hill ", "fr": "la maison du vieil homme et de la mer était sur la colline ", "DE": "das haus des alten mannes und das meer war auf dem hügel "}
    rows = [(t * 3, lang) for lang, t in texts.items()] + [("xq", "zz"), (None, "en")]
    model = LanguageModel.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["de", "en", "fr"]
    asked = [(1, "The man and the house"), (2, "LA MER et la maison"), (3, "das Meer"), (4, None), (5, "12 !"), (6, "a"), (7, "漢字漢字")]
    got = {r.id: (r.language, r.confidence) for r in model.detect(spark.createDataFrame(asked, "id long, text string"), "id").collect()}
    assert [got[i][0] for i in range(1, 8)] == ["en", "fr", "de", None, None, None, None]
    assert all(0.9 < got[i][1] <= 1 for i in (1, 2, 3)) and got[4][1] is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_language_model_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang IS NOT NULL")
    new = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) >= "8"
    docs = docs.repartition(8)
    got = LanguageModel.fit(docs.filter(~new)).detect(docs.filter(new), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    right, every = got.agg(F.count_if(F.expr("language = lang")), F.count(F.lit(1))).first()
    assert every > 4000 and right / every >= 0.98


def test_densest_stretch(spark):
    prose = "Water stood on the lower road for days , and nobody knew who had the key . "
    page = f"<html><head><title>T</title></head><body><nav><p><a href=/>Home page of the paper</a></p></nav><div class=x>Buy two</div><div><h1>Water</h1><p>{prose * 2}<b>Bold</b> end.<br>New&nbsp;line &amp; more<p>Of.</p><script>var p='<p>x</p>'</script></div><div>All rights reserved</div><footer><p>{prose * 3}</p></footer></body></html>"
    want = f"Water {(prose * 2).strip()} Bold end. New line & more Of."
    frame = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<div>few words</div>"), (5, "<div>" + "long " * 30)], "id long, html string")
    assert {r.id: r.body for r in stretch.with_stretch(frame).collect()} == {1: want, 2: "", 3: "", 4: "", 5: ("long " * 30).strip()}
    for _ in range(200):
        worths = [random.randrange(-9, 10) for _ in range(random.randrange(12))]
        start, end = stretch.densest(worths)
        assert sum(worths[start:end]) == max([0] + [sum(worths[i:j]) for i in range(len(worths)) for j in range(i, len(worths) + 1)])
    d = spark.createDataFrame([("u", page)], "url string, html string")
    got = documents.page_articles(d, F.current_timestamp()).first()
    assert (got.extraction_method, got.body, got.error) == ("dense", want, None)


def test_open_references_stay(spark):
    d = spark.createDataFrame([("<h1>Salt &amp;&amp</h1><p>and &copy me &copy; you &#65; &#65</p>",)], "html string")
    assert stretch.with_stretch(d).first().body == "Salt &&amp and &copy me © you A &#65"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_deliveries_are_staged_by_more_than_three_tasks(spark, tmp_path, monkeypatch):
    from newsloom.plans import queries

    monkeypatch.setattr(queries, "folder", lambda spark, name: f"{tmp_path}/{name}")
    got = queries.delivery_report(spark, SF.replace("sf0.1", "sf0.001")).collect()
    files = [f for f in os.listdir(f"{tmp_path}/producer/in") if f.endswith(".parquet")]
    assert len(got) == 6 and len(files) > 3 and len(os.listdir(f"{tmp_path}/producer/staged")) == 3
