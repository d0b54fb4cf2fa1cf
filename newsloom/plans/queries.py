"""Queries over the driver's tables, one for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import language, text, times, urls
from newsloom.lineage import spread
from newsloom.operators import breaker, dedup, metrics, normalize, registry, rules
from newsloom.plans import pipeline
from newsloom.plugins import Summarizer
from newsloom.sources import documents, sinks

AS_OF = "2024-02-01 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def now():
    return F.lit(AS_OF).cast("timestamp")


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark, sf_dir):
    return pipeline.from_documents(spread(read(spark, sf_dir, "documents")))


def events(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("failed", F.col("event_type") == "error").withColumn("feed_id", F.col("user_id"))


WORDS = {k: ", ".join(f"'{w}'" for w in v) for k, v in language.WORDS.items()}
_ART = r"""
WITH a AS (SELECT doc_id, text AS body, source, split_part(text, chr(10), 1) AS title,
    'https://' || coalesce(source, 'none') || '.example.com/a/' || doc_id || '?utm_source=feed&id=' || doc_id AS url,
    make_timestamp((1704067200 + doc_id * 3600) * 1000000) AS published_at FROM documents)"""
_EVAL = (
    _ART
    + ", t AS (SELECT *, regexp_split_to_array(lower(body), '[^\\p{L}]+') AS tok, len(list_filter(regexp_split_to_array(body, '[\\s\\x0b\\x{85}\\x{a0}\\x{1c}-\\x{1f}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: x <> '')) AS n_words FROM a), c AS (SELECT *, "
    + ", ".join(f"len(list_filter(tok, lambda w: w IN ({w}))) AS n_{k}" for k, w in WORDS.items())
    + " FROM t), l AS (SELECT *, greatest(n_en, n_fr, n_de, n_es) AS best, n_en + n_fr + n_de + n_es AS total FROM c), "
    + """m AS (SELECT *, CASE WHEN total > 0 THEN CASE best WHEN n_en THEN 'en' WHEN n_fr THEN 'fr' WHEN n_de THEN 'de' ELSE 'es' END END AS lang_code,
  CASE WHEN total > 0 THEN best::DOUBLE / total END AS conf FROM l),
e AS (SELECT *, CASE WHEN floor((epoch_us(published_at) - epoch_us(TIMESTAMP '2024-02-01')) / 86400000000.0) > 0 OR floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(published_at)) / 86400000000.0) > 36500
    THEN 'R1: Timestamp is unreasonable (too far in past or future)' END AS r1,
  CASE WHEN body = '' THEN 'R2: Cannot detect language of empty body' WHEN conf IS NULL OR conf < 0.8 THEN 'R2: Language detection failed'
    WHEN length(body) >= 500 AND conf < 0.9 THEN 'R2: Language confidence below 0.9 threshold' END AS r2,
  CASE WHEN body = '' THEN 'R3: Missing body for deduplication' END AS r3,
  CASE WHEN coalesce(source, '') = '' THEN 'R6: Missing source field' END AS r6,
  CASE WHEN length(title) < 5 THEN 'CONTENT: Title too short (minimum 5 characters)' WHEN length(body) < 50 THEN 'CONTENT: Body too short (minimum 50 characters)'
    WHEN length(body) < 500 AND n_words < 5 THEN 'CONTENT: Body has too few words (minimum 5)' WHEN length(body) >= 500 AND n_words < 20 THEN 'CONTENT: Body has too few words (minimum 20)' END AS rc FROM m),
v AS (SELECT *, list_filter([r1, r2, r3, r6, rc], lambda x: x IS NOT NULL) AS errors,
  1.0::DOUBLE - CASE WHEN r1 IS NULL THEN 0 ELSE 0.15::DOUBLE END - CASE WHEN r2 IS NULL THEN 0 ELSE 0.15::DOUBLE END - CASE WHEN r3 IS NULL THEN 0 ELSE 0.1::DOUBLE END
  - CASE WHEN r6 IS NULL THEN 0 ELSE 0.15::DOUBLE END - CASE WHEN rc IS NULL THEN 0 ELSE 0.15::DOUBLE END AS score FROM e)"""
)


def evaluated(spark, sf_dir):
    return rules.evaluate(articles(spark, sf_dir), now()).withColumn("doc_id", F.col("arrival"))


@query(_EVAL + " SELECT source, count(*) AS articles, count(*) FILTER (len(errors) = 0) AS valid, min(score) AS least_score FROM v GROUP BY source")
def validate_summary_by_source(spark, sf_dir):
    return evaluated(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("articles"), F.count_if("is_valid").alias("valid"), F.min("validation_score").alias("least_score"))


@query(_EVAL + " SELECT doc_id, coalesce(array_to_string(errors, '|'), '') AS errors, score FROM v")
def rule_errors(spark, sf_dir):
    return evaluated(spark, sf_dir).select("doc_id", F.array_join("errors", "|").alias("errors"), F.col("validation_score").alias("score"))


@query(_EVAL + " SELECT score, len(errors) = 0 AS is_valid, count(*) AS articles FROM v GROUP BY ALL")
def score_distribution(spark, sf_dir):
    return evaluated(spark, sf_dir).groupBy(F.col("validation_score").alias("score"), "is_valid").agg(F.count(F.lit(1)).alias("articles"))


@query(_EVAL + ", x AS (SELECT doc_id, source, unnest(errors) AS error_message FROM v) SELECT doc_id, split_part(error_message, ': ', 1) AS rule_id, error_message, source AS feed_id FROM x")
def validation_log(spark, sf_dir):
    log = rules.validation_log(evaluated(spark, sf_dir), now())
    return log.select(F.split("record_id", ":")[0].cast("long").alias("doc_id"), "rule_id", "error_message", "feed_id")


@query(_EVAL + " SELECT doc_id, title FROM v WHERE len(errors) = 0")
def valid_articles(spark, sf_dir):
    return evaluated(spark, sf_dir).filter("is_valid").select("doc_id", "title")


@query(_EVAL + " SELECT doc_id, lang_code, conf FROM v")
def language_detect(spark, sf_dir):
    return evaluated(spark, sf_dir).select("doc_id", "lang_code", F.col("lang_confidence").alias("conf"))


@query(_EVAL + " SELECT lang_code, count(*) AS articles, count(r2) AS failed FROM v GROUP BY lang_code")
def language_confidence_rule(spark, sf_dir):
    return evaluated(spark, sf_dir).groupBy("lang_code").agg(F.count(F.lit(1)).alias("articles"), F.count("rule_errors.R2").alias("failed"))


@query("SELECT doc_id, lower(lang) IN (%s) AS supported FROM documents" % ", ".join(f"'{x}'" for x in language.SUPPORTED))
def supported_language(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", language.supported(F.col("lang")).alias("supported"))


_GRAMS = r"""WITH t AS (SELECT doc_id, lower(lang) AS lang, substr(md5(doc_id::VARCHAR), 1, 1) < '8' AS learnt, string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', ' ', 'g'), '') AS c FROM documents),
g AS (SELECT doc_id, lang, learnt, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM t WHERE len(c) > 2),
n AS (SELECT lang, gram, count(*) AS n FROM g WHERE learnt AND lang IN (%s) GROUP BY ALL),
v AS (SELECT DISTINCT gram FROM (SELECT gram FROM n QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) <= 300)),
l AS (SELECT DISTINCT lang FROM n), a AS (SELECT lang, sum(n)::BIGINT AS n FROM n JOIN v USING (gram) GROUP BY lang),
w AS (SELECT l.lang, v.gram, round(1000 * ln((coalesce(n.n, 0) + 1)::DOUBLE / (a.n + (SELECT count(*) FROM v))))::BIGINT AS w FROM l CROSS JOIN v JOIN a ON a.lang = l.lang LEFT JOIN n ON n.lang = l.lang AND n.gram = v.gram),
s AS (SELECT doc_id, w.lang, sum(w)::BIGINT AS s FROM g JOIN w USING (gram) GROUP BY ALL),
b AS (SELECT doc_id, max(s) AS s FROM s GROUP BY doc_id),
p AS (SELECT doc_id, min(s.lang) FILTER (s.s = b.s) AS language, round(1 / sum(exp((s.s - b.s) / 1000.0::DOUBLE)), 6) AS confidence FROM s JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, language, confidence FROM documents LEFT JOIN p USING (doc_id)""" % ", ".join(f"'{x}'" for x in language.SUPPORTED)


def learnt(docs):
    """Documents that the language model learns from; the others are held out."""
    return docs.filter(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8")


@query(_GRAMS)
def language_model(spark, sf_dir):
    """Every document's language by a model of about half of them."""
    from newsloom.operators.langmodel import LanguageModel

    docs = read(spark, sf_dir, "documents")
    return LanguageModel.fit(learnt(docs)).detect(docs, "doc_id")


_WS = r"[\s\x0b\x{85}\x{a0}\x{1c}-\x{1f}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_NORM = rf"trim(regexp_replace(regexp_replace(text, '{_WS}', ' ', 'g'), '[\x00-\x08\x0b-\x1f]', '', 'g'))"


@query(f"SELECT doc_id, {_NORM} AS body FROM documents")
def normalize_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("body"))


@query(f"SELECT doc_id, sha256({_NORM}) AS checksum, md5({_NORM}) AS digest, true AS verified FROM documents")
def body_checksum(spark, sf_dir):
    body = text.normalize_text(F.col("text"))
    d = read(spark, sf_dir, "documents").select("doc_id", body.alias("b"))
    return d.select("doc_id", text.sha256(F.col("b")).alias("checksum"), text.md5(F.col("b")).alias("digest"), text.verify_checksum(F.col("b"), F.upper(text.sha256(F.col("b")))).alias("verified"))


_TRACK = ", ".join(f"'{x}'" for x in urls.TRACKING)


@query(rf"""WITH p AS (SELECT page_id, regexp_extract(url, '^[^?#]*') AS front, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({_TRACK})) AS q FROM pages)
SELECT page_id, front || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM p""")
def canonical_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("url"))


@query(r"SELECT page_id, regexp_replace(regexp_extract(url, '^[^?#]*'), '/$', '') AS url FROM pages")
def key_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.key_url(F.col("url")).alias("url"))


@query(r"SELECT replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), 'www.', '') AS domain, count(*) AS pages FROM pages GROUP BY 1")
def domain(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


@query("SELECT event_id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS iso, true AS valid FROM events")
def iso_timestamp(spark, sf_dir):
    iso = times.to_iso(F.col("ts"))
    return events(spark, sf_dir).select("event_id", iso.alias("iso"), (times.from_iso(iso) == F.col("ts")).alias("valid"))


@query("SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second FROM events")
def timestamp_components(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", times.components(F.col("ts")).alias("c")).select("event_id", "c.year", "c.month", "c.day", "c.hour", "c.minute", "c.second")


@query("SELECT event_id, floor((epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(ts)) / 86400000000.0) <= 36500 AND floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 86400000000.0) <= 0 AS reasonable FROM events")
def reasonable_date(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", times.reasonable(F.col("ts"), F.lit("2024-01-15 12:00:00").cast("timestamp")).alias("reasonable"))


@query(rf"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> ''))::BIGINT AS words FROM documents")
def word_count(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query(r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS body FROM documents")
def clean_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("body"))


@query("SELECT doc_id, true AS valid, md5(text) AS digest FROM documents")
def utf8_check(spark, sf_dir):
    raw = F.encode("text", "UTF-8")
    return read(spark, sf_dir, "documents").select("doc_id", text.valid_utf8(raw.cast("string")).alias("valid"), F.md5(text.ensure_utf8(raw.cast("string"))).alias("digest"))


_FEEDS = "WITH f(feed_id, name, url, language, country) AS (VALUES " + ", ".join("('" + "', '".join(r) + "')" for r in registry.DEFAULT_FEEDS) + ")"


@query(_FEEDS + " SELECT feed_id, name, url FROM f")
def feeds_enabled(spark, sf_dir):
    return registry.enabled(registry.feeds(spark)).select("feed_id", "name", "url")


@query(_FEEDS + " SELECT feed_id, country FROM f WHERE lower(country) = 'gb'")
def feeds_by_country(spark, sf_dir):
    return registry.by(registry.feeds(spark), "country", "Gb").select("feed_id", "country")


@query(_FEEDS + " SELECT feed_id, language FROM f WHERE lower(language) = 'fa'")
def feeds_by_language(spark, sf_dir):
    return registry.by(registry.feeds(spark), "language", "FA").select("feed_id", "language")


@query(_FEEDS + " SELECT feed_id, 'rss' AS feed_type FROM f")
def feeds_by_type(spark, sf_dir):
    return registry.by(registry.feeds(spark), "feed_type", "RSS").select("feed_id", "feed_type")


@query(_FEEDS + " SELECT 'all' AS dimension, 'total' AS value, count(*) AS feeds FROM f UNION ALL SELECT 'all', 'enabled', count(*) FROM f UNION ALL SELECT 'feed_type', 'rss', count(*) FROM f UNION ALL SELECT 'country', country, count(*) FROM f GROUP BY country UNION ALL SELECT 'language', language, count(*) FROM f GROUP BY language")
def registry_stats(spark, sf_dir):
    return registry.stats(registry.feeds(spark))


@query(_FEEDS + " SELECT country, language, count(*) AS feeds FROM f GROUP BY GROUPING SETS ((country), (language), ())")
def registry_grouping_sets(spark, sf_dir):
    registry.feeds(spark).createOrReplaceTempView("newsloom_feeds")
    return spark.sql("SELECT country, language, count(*) AS feeds FROM newsloom_feeds GROUP BY GROUPING SETS ((country), (language), ())")


@query(_FEEDS + " SELECT feed_id FROM f")
def feeds_bulk_registration(spark, sf_dir):
    return registry.register(registry.feeds(spark), registry.bulk_feeds(spark)).select("feed_id")


@query(_FEEDS + " SELECT feed_id, feed_id <> 'rt' AS enabled FROM f WHERE feed_id <> 'cnn'")
def registry_changes(spark, sf_dir):
    r = registry.set_enabled(registry.remove(registry.feeds(spark), "cnn"), "rt", False)
    return r.select("feed_id", "enabled")


@query(_FEEDS + ", l AS (SELECT feed_id, row_number() OVER (ORDER BY feed_id) AS i FROM f) SELECT feed_id FROM l WHERE i % 3 = 0 OR 10 * i >= 30")
def due_feeds(spark, sf_dir):
    r = registry.feeds(spark)
    ids = sorted(f[0] for f in registry.DEFAULT_FEEDS)
    last = spark.createDataFrame([(f, 10 * (i + 1)) for i, f in enumerate(ids) if (i + 1) % 3], "feed_id string, minutes int")
    last = last.select("feed_id", (now() - F.make_dt_interval(mins=F.col("minutes"))).alias("last_crawled_at"))
    return registry.due(r, last, now()).select("feed_id")


@query("SELECT n AS copies, count(*) AS texts FROM (SELECT count(*) AS n FROM documents GROUP BY text) GROUP BY n")
def exact_duplicates(spark, sf_dir):
    d = read(spark, sf_dir, "documents").groupBy(text.sha256(F.col("text")).alias("h")).agg(F.count(F.lit(1)).alias("copies"))
    return d.groupBy("copies").agg(F.count(F.lit(1)).alias("texts"))


_SH = (
    rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(split_part(text, chr(10), 1) || ' ' || text), '{_WS}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 4 THEN [] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w)"""
)
_K = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(dedup.coefficients()))
_SIG = _SH + rf""", y AS (SELECT doc_id, list_transform(w, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % {dedup.P}) AS y FROM w),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(y) - 2), lambda i: (((y[i] * {dedup.JOIN} + y[i + 1]) % {dedup.P} * {dedup.JOIN} + y[i + 2]) % {dedup.P} * {dedup.JOIN} + y[i + 3]) % {dedup.P})) AS h FROM y WHERE len(y) >= 4), k(k, a, b) AS (VALUES {_K}),
m AS (SELECT doc_id, k, min((a * h + b) % {dedup.P}) AS v FROM g, k GROUP BY doc_id, k),
z AS (SELECT s.doc_id, k.k, coalesce(m.v, {dedup.P}) AS v FROM s CROSS JOIN k LEFT JOIN m ON m.doc_id = s.doc_id AND m.k = k.k),
sig AS (SELECT doc_id, list(v ORDER BY k) AS sig FROM z GROUP BY doc_id),
band AS (SELECT doc_id, i, i || ':' || md5(array_to_string(sig[i * 5 + 1:i * 5 + 5], ',')) AS band FROM sig, range({dedup.BANDS}) r(i))"""


@query(_SH + " SELECT doc_id, len(s)::BIGINT AS shingles FROM s")
def shingle_counts(spark, sf_dir):
    content = F.concat("title", F.lit(" "), "body")
    return articles(spark, sf_dir).select(F.col("arrival").alias("doc_id"), F.size(text.shingles(content)).cast("long").alias("shingles"))


def signed(spark, sf_dir):
    return dedup.signatures(articles(spark, sf_dir).select(F.col("arrival").alias("doc_id"), "title", "body"))


@query(_SIG + " SELECT doc_id, md5(array_to_string(sig, ',')) AS signature, sig[1] AS first FROM sig")
def minhash_signature(spark, sf_dir):
    return signed(spark, sf_dir).select("doc_id", F.md5(F.array_join("signature", ",")).alias("signature"), F.col("signature")[0].alias("first"))


@query(_SIG + " SELECT band, count(*) AS articles FROM band GROUP BY band HAVING count(*) > 1")
def lsh_bands(spark, sf_dir):
    bands = signed(spark, sf_dir).select(F.explode(dedup.band_keys(F.col("signature"))).alias("band"))
    return bands.groupBy("band").agg(F.count(F.lit(1)).alias("articles")).filter("articles > 1")


@query(_SIG + ", led AS (SELECT min(doc_id) AS doc_id FROM sig GROUP BY sig), b AS (SELECT band.* FROM band JOIN led USING (doc_id)) SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS bands FROM b x JOIN b y ON x.band = y.band AND x.doc_id < y.doc_id GROUP BY ALL")
def lsh_candidate_pairs(spark, sf_dir):
    return dedup.candidate_pairs(signed(spark, sf_dir), "doc_id")


@query(_SIG + ", led AS (SELECT min(doc_id) AS doc_id FROM sig GROUP BY sig), b AS (SELECT band.* FROM band JOIN led USING (doc_id)), p AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM b x JOIN b y ON x.band = y.band AND x.doc_id < y.doc_id) SELECT a, b, len(list_filter(range(1, 129), lambda i: x.sig[i] = y.sig[i]))::DOUBLE / 128 AS estimate FROM p JOIN sig x ON x.doc_id = a JOIN sig y ON y.doc_id = b")
def similar_articles(spark, sf_dir):
    return dedup.similar(signed(spark, sf_dir), None, "doc_id").select("a", "b", "estimate")


_RECURSIVE = _SIG.replace("WITH w AS", "WITH RECURSIVE words AS", 1).replace("FROM w)", "FROM words)").replace("FROM w)", "FROM words)")
_WINS = """, n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, {may} AS may FROM {base}),
ids AS (SELECT band, row_number() OVER () AS b FROM (SELECT DISTINCT band FROM band)),
mine AS (SELECT doc_id, list(b) AS bs FROM band JOIN ids USING (band) GROUP BY doc_id),
seq AS MATERIALIZED (SELECT k, doc_id, may, bs FROM n JOIN mine USING (doc_id)),
w(k, doc_id, dup, kept) AS (SELECT 0::BIGINT, NULL::BIGINT, false, []::BIGINT[] UNION ALL
  SELECT q.k, q.doc_id, list_has_any(w.kept, q.bs), CASE WHEN q.may AND NOT list_has_any(w.kept, q.bs) THEN list_concat(w.kept, q.bs) ELSE w.kept END FROM w JOIN seq q ON q.k = w.k + 1)"""


@query(_RECURSIVE + _WINS.format(may="true", base="sig") + " SELECT doc_id, dup AS is_duplicate FROM w WHERE k > 0")
def dedup_first_wins(spark, sf_dir):
    return dedup.first_wins(signed(spark, sf_dir).withColumn("publishable", F.lit(True)), "doc_id")


@query(
    _RECURSIVE
    + """, ids AS (SELECT band, row_number() OVER () AS b FROM (SELECT DISTINCT band FROM band)),
mine AS (SELECT doc_id, list(b) AS bs FROM band JOIN ids USING (band) GROUP BY doc_id), seq AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, bs FROM mine),
w(k, doc_id, dup, kept) AS (SELECT 0::BIGINT, NULL::BIGINT, false, []::BIGINT[][] UNION ALL
  SELECT q.k, q.doc_id, list_has_any(flatten(w.kept), q.bs), CASE WHEN list_has_any(flatten(w.kept), q.bs) THEN w.kept WHEN len(w.kept) < 200 THEN list_append(w.kept, q.bs) ELSE list_append(w.kept, q.bs)[21:] END FROM w JOIN seq q ON q.k = w.k + 1)
SELECT doc_id, dup AS is_duplicate FROM w WHERE k > 0"""
)
def dedup_bounded_store(spark, sf_dir):
    """First wins among 200 places: the oldest 20 leave when there is one more."""
    from newsloom.operators import evict

    return evict.bounded_first_wins(signed(spark, sf_dir).withColumn("publishable", F.lit(True)), 200, "doc_id")


@query("SELECT min(n)::BIGINT AS size, 10000::BIGINT AS max_size, 128::BIGINT AS permutations, min(n) * 100.0::DOUBLE / 10000 AS usage_percent FROM (SELECT count(*) AS n FROM documents)")
def cache_stats(spark, sf_dir):
    return dedup.cache_stats(read(spark, sf_dir, "documents"), 10_000)


_PLAIN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({}, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \\t\\n\\r\\f]+', ' ', 'g'))"


@query("SELECT page_id, " + _PLAIN.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + " AS title FROM pages")
def html_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", documents.page_title(F.col("html")).alias("title"))


@query(
    "WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g') AS h FROM pages) SELECT page_id, "
    + _PLAIN.format("regexp_extract(h, '(?is)<(?:article|main)[^>]*>(.*)</(?:article|main)>', 1)")
    + " AS body, 'marked' AS extraction_method FROM c"
)
def html_article(spark, sf_dir):
    return documents.page_articles(read(spark, sf_dir, "pages").select("page_id", "url", "html"), now()).select("page_id", "body", "extraction_method")


@query(
    "WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g') AS h FROM pages) SELECT page_id, "
    + _PLAIN.format("regexp_extract(h, '(?is)<(?:article|main)[^>]*>(.*)</(?:article|main)>', 1)")
    + " AS body FROM c"
)
def html_densest(spark, sf_dir):
    """The text of pages whose article marks are taken out; the SQL reads it by the marks."""
    from newsloom.sources.stretch import with_stretch

    bare = F.regexp_replace("html", r"(?i)</?(?:article|main)\b[^>]*>", "")
    return with_stretch(read(spark, sf_dir, "pages").select("page_id", bare.alias("html"))).select("page_id", "body")


@query("SELECT source AS feed_id, count(*) AS entries, min(doc_id) AS first FROM documents GROUP BY source")
def rss_entries(spark, sf_dir):
    """Each source's documents as a feed of its own chunk, parsed back."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    d = read(spark, sf_dir, "documents").withColumn("chunk", F.floor(F.col("doc_id") / 100))
    item = F.concat(F.lit("<item><title>"), esc(F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^\n]*", 0)), F.lit("x</title><link>https://e.example/"), F.col("doc_id"), F.lit("</link><description>body "), F.col("doc_id"), F.lit(" "), esc(F.coalesce("text", F.lit(""))), F.lit("</description></item>"))
    feed = d.groupBy(F.col("source").alias("feed_id"), "chunk").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("content"))
    found = documents.feed_entries(feed.withColumn("url", F.lit("")), now())
    return found.filter("error IS NULL").groupBy("feed_id").agg(F.count(F.lit(1)).alias("entries"), F.min(F.regexp_extract("url", r"(\d+)$", 1).cast("long")).alias("first"))


@query("SELECT CASE WHEN page_id % 3 = 0 THEN 'rss' WHEN page_id % 3 = 1 THEN 'html' END AS parser, CASE WHEN page_id % 3 = 2 THEN 'PARSER_UNKNOWN' END AS error, count(*) AS documents FROM pages GROUP BY ALL")
def mime_dispatch(spark, sf_dir):
    kinds = F.array(F.lit("Text/XML"), F.lit("text/html"), F.lit("text/xml; charset=utf-8"))
    d = read(spark, sf_dir, "pages").withColumn("content_type", F.element_at(kinds, (F.pmod("page_id", F.lit(3)) + 1).cast("int")))
    return documents.dispatch(d).groupBy("parser", "error").agg(F.count(F.lit(1)).alias("documents"))


def status(spark, sf_dir):
    return pipeline.with_status(articles(spark, sf_dir), now())


_STATUS = (
    _RECURSIVE
    + ", "
    + _EVAL.strip().removeprefix("WITH ").replace("m AS (SELECT *, CASE WHEN total", "told AS (SELECT *, CASE WHEN total").replace("AS rc FROM m)", "AS rc FROM told)")
    + _WINS.format(may="len(errors) = 0 AND coalesce(length(lang_code) = 2, false)", base="v")
    + """, st AS (SELECT v.*, CASE WHEN dup THEN 'duplicate' WHEN len(errors) > 0 THEN 'invalid' WHEN coalesce(length(lang_code) = 2, false) THEN 'published' ELSE 'error' END AS status FROM v JOIN w USING (doc_id) WHERE k > 0)"""
)


@query(_STATUS + " SELECT doc_id, status FROM st")
def pipeline_status(spark, sf_dir):
    return status(spark, sf_dir).select(F.col("arrival").alias("doc_id"), "status")


@query(_STATUS + " SELECT source AS feed_id, count(*) FILTER (status <> 'invalid') AS articles_crawled, count(*) FILTER (status = 'published') AS articles_published, count(*) FILTER (status = 'duplicate') AS articles_duplicate, count(*) FILTER (status IN ('invalid', 'error')) AS articles_failed FROM st GROUP BY source")
def crawl_job_counters(spark, sf_dir):
    return metrics.job_counters(status(spark, sf_dir).withColumnRenamed("source", "feed_id"), "feed_id")


@query(
    _STATUS
    + rf""", u AS (SELECT *, 'https://' || coalesce(source, 'none') || '.example.com/a/' || doc_id || '?id=' || doc_id AS canonical FROM st WHERE status = 'published')
SELECT sha256(canonical || '|' || doc_id) AS article_id, canonical AS canonical_url, {_NORM.replace("text", "title", 1)} AS title, {_NORM.replace("text", "body", 1)} AS body, url, source, lang_code AS language, strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS published_at,
  '2024-02-01T00:00:00Z' AS crawled_at, NULL::VARCHAR AS country, sha256({_NORM.replace("text", "body", 1)}) AS checksum, score AS validation_score, 'v1.0' AS schema_version, 'job' AS ingest_job_id, 'newsloom' AS publisher_id, NULL::VARCHAR AS author, NULL::VARCHAR AS raw_html, 'document' AS extraction_method FROM u"""
)
def messages(spark, sf_dir):
    return pipeline.run(articles(spark, sf_dir), now()).messages.drop("metadata")


@query(_EVAL + rf""" SELECT doc_id, 'https://' || coalesce(source, 'none') || '.example.com/a/' || doc_id || '?id=' || doc_id AS canonical_url, {_NORM.replace("text", "title", 1)} AS title, lang_code AS language, sha256({_NORM.replace("text", "body", 1)}) AS checksum,
  strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS published_at, score AS validation_score FROM v WHERE lang_code IS NOT NULL""")
def normalized_messages(spark, sf_dir):
    m = normalize.messages(evaluated(spark, sf_dir), now())
    return m.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("doc_id"), "canonical_url", "title", "language", "checksum", "published_at", "validation_score")


@query("SELECT event_type, user_id, count(*) AS value FROM events GROUP BY ALL")
def counter_by_label(spark, sf_dir):
    return metrics.counters(events(spark, sf_dir), "event_type", "user_id")


_BUCKETS = metrics.BUCKETS["fetch"]


@query(" UNION ALL ".join([f"SELECT event_type, '{b}' AS le, count(*) FILTER (value <= {b}::DOUBLE) AS count FROM events GROUP BY event_type" for b in _BUCKETS] + ["SELECT event_type, '+Inf', count(value) FROM events GROUP BY event_type"]))
def histogram_buckets(spark, sf_dir):
    return metrics.histogram(events(spark, sf_dir), "value", _BUCKETS, "event_type")


@query("SELECT event_type, count(value) AS count, sum(value::DECIMAL(18, 4))::DOUBLE AS sum FROM events GROUP BY event_type")
def summary_stats(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("value", F.col("value").cast("decimal(18,4)"))
    return metrics.summary(e, "value", "event_type").withColumn("sum", F.col("sum").cast("double"))


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS value FROM events GROUP BY user_id")
def gauge_latest(spark, sf_dir):
    return metrics.gauge(events(spark, sf_dir), "event_id", F.struct("ts", "event_id"), "user_id")


_CHECKS = [("database", "healthy"), ("message_sink", "degraded"), ("feed_registry", "healthy"), ("proxy", "unhealthy")]


@query("SELECT 'unhealthy' AS status, true AS ready")
def health_rollup(spark, sf_dir):
    checks = spark.createDataFrame(_CHECKS, "name string, status string")
    return metrics.health(checks).join(F.broadcast(metrics.ready(checks)))


@query("SELECT 'newsloom_events{event_type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def metrics_exposition(spark, sf_dir):
    return metrics.exposition(metrics.counters(events(spark, sf_dir), "event_type"), "newsloom_events")


@query("""WITH r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS failures FROM r WHERE event_type = 'error')
SELECT user_id AS feed_id, event_id, ts, failures, ts + INTERVAL 10 MINUTE AS open_until FROM f WHERE failures >= 3""")
def circuit_breaker_opens(spark, sf_dir):
    o = breaker.openings(events(spark, sf_dir))
    return o.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("open_until", F.col("open_until").cast("timestamp_ntz"))


_OPENINGS = """r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS failures FROM r WHERE event_type = 'error'), o AS (SELECT user_id, event_id, ts FROM f WHERE failures >= 2)"""


@query(f"WITH {_OPENINGS} SELECT e.event_id, o.event_id AS opened_by, o.ts AS opened_at, coalesce(e.ts <= o.ts + INTERVAL 6 HOUR, false) AS refused FROM events e ASOF LEFT JOIN o ON e.user_id = o.user_id AND e.ts >= o.ts")
def breaker_asof(spark, sf_dir):
    """For each event the opening of its feed's breaker before it, and whether that was still open."""
    from newsloom.operators.asof import asof_join

    e = events(spark, sf_dir).select("feed_id", "event_id", "ts", "failed")
    o = breaker.openings(e, 2, 360).select("feed_id", "event_id", "ts", "open_until")
    joined = asof_join(e, o, "feed_id", "ts", "event_id")
    return joined.select("event_id", F.col("right_row.event_id").alias("opened_by"), F.col("right_row.ts").cast("timestamp_ntz").alias("opened_at"), F.coalesce(F.col("ts") <= F.col("right_row.open_until"), F.lit(False)).alias("refused"))


def folder(spark, name):
    """A new folder that the driver and all executors share."""
    import uuid

    from newsloom.lineage import shared_dir

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""WITH RECURSIVE m AS (SELECT (epoch_us(max(ts)) // 1000 - 600000) * 1000 AS mark FROM events),
e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events, m WHERE epoch_us(ts) < mark),
s(user_id, k, t, event_id, failed, was, failures, until) AS (SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, NULL::BIGINT, false, NULL::BIGINT, 0::BIGINT, NULL::BIGINT FROM e UNION ALL
  SELECT e.user_id, e.k, e.t, e.event_id, e.failed, s.until, CASE WHEN NOT e.failed THEN 0 WHEN s.until < e.t THEN 1 ELSE s.failures + 1 END,
    CASE WHEN e.failed AND (s.until IS NULL OR s.until >= e.t) AND s.failures >= 2 THEN e.t + 86400000000 END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1),
o AS (SELECT user_id, NULL AS event_id, was AS t, 'close' AS kind, 0 AS failures, NULL AS until FROM s WHERE was < t
  UNION ALL SELECT user_id, event_id, t, CASE WHEN was IS NULL THEN 'open' ELSE 'extend' END, failures, until FROM s WHERE until IS NOT NULL
  UNION ALL SELECT user_id, event_id, t, 'close', 0, NULL FROM s WHERE NOT failed AND was >= t
  UNION ALL SELECT user_id, NULL, until, 'close', 0, NULL FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1), m WHERE until < mark)
SELECT user_id AS feed_id, event_id, make_timestamp(t) AS ts, kind, failures, make_timestamp(until) AS open_until FROM o""")
def breaker_stream(spark, sf_dir):
    """Breakers of one day, streamed in three runs that each go on from the checkpoint of the one before."""
    from newsloom.streaming.breakers import BreakerStream

    e = events(spark, sf_dir).select("feed_id", "event_id", "ts", "failed")
    stream = BreakerStream(folder(spark, "breakers"), minutes=1440)
    bounds = e.agg(F.percentile_approx("ts", F.array(F.lit(0.3), F.lit(0.7)))).first()[0]
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = e if low is None else e.filter(F.col("ts") >= F.lit(low))
        (part if high is None else part.filter(F.col("ts") < F.lit(high))).write.mode("append").parquet(stream.events)
        stream.run(spark)
    r = stream.result(spark)
    return r.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("open_until", F.col("open_until").cast("timestamp_ntz"))


@query("""SELECT ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 6 AS partition, count(*) FILTER (length(text) >= 500) AS delivered, max(length(text)) FILTER (length(text) >= 500) AS largest FROM documents GROUP BY 1""")
def delivery_report(spark, sf_dir):
    """Documents streamed in several batches: long ones to the topic, others to the dead letters; what each partition was given."""
    from newsloom.streaming.delivery import Producer

    root = folder(spark, "producer")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # three batches of as many files as there are read tasks or cores, so no task grows with the table
    files = max(docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    docs.repartition(3 * files).write.parquet(f"{root}/in")
    rows = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    producer = Producer(root)
    producer.start(rows.select(F.col("doc_id").alias("key"), F.col("text").alias("value"), (F.length("text") >= 500).alias("good"), F.lit("TOO_SHORT").alias("error")))
    producer.stop()
    return producer.report(spark)


@query("SELECT source, CASE WHEN source IN ('src1', 'src2') THEN 'short' ELSE 'all' END AS load, count(*) AS documents, sum(length(text))::BIGINT AS chars FROM documents WHERE source NOT IN ('src1', 'src2') OR length(text) < 1000 GROUP BY ALL HAVING count(*) >= 3")
def catalog_by_source(spark, sf_dir):
    """Documents in a table by source; then the partitions of two sources are replaced by their short documents."""
    import uuid

    from newsloom.sources import catalog

    docs = read(spark, sf_dir, "documents").filter("source IS NOT NULL").select("doc_id", "text", F.lit("all").alias("load"), "source")
    name = f"newsloom_documents_{uuid.uuid4().hex}"
    catalog.create(spark, name, docs.schema, ("source",), folder(spark, "catalog"))
    catalog.load(docs, name)
    catalog.load(docs.filter((F.length("text") < 1000) & F.col("source").isin("src1", "src2")).withColumn("load", F.lit("short")), name)
    return catalog.ask(spark, f"SELECT source, load, count(*) AS documents, sum(length(text)) AS chars FROM {name} GROUP BY source, load HAVING count(*) >= :least", least=3)


@query("SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, url, md5(html) AS digest FROM pages WHERE regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) LIKE 'm.%'")
def sites(spark, sf_dir):
    """Pages in a folder by host, read back host by host, one session each; only hosts that are asked for are opened."""
    from newsloom.sources import sites as source

    root = folder(spark, "sites")
    pages = read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"), "url", "html")
    pages.repartition("host").write.partitionBy("host").parquet(root)
    source.register(spark)
    found = spark.read.format("newsloom_sites").option("path", root).load().filter(F.col("host").startswith("m."))
    return found.select("host", "url", F.md5("content").alias("digest"))


@query("SELECT range AS attempt, CASE WHEN range < 5 THEN 30 * 2 ** range ELSE 0 END::BIGINT AS wait_seconds, (30 * (2 ** range - 1))::BIGINT AS started_at_seconds FROM range(6)")
def retry_schedule(spark, sf_dir):
    return breaker.retry_schedule(spark)


@query("SELECT to_json({'conv_id': conv_id, 'turn': turn, 'role': role, 'text': text})::VARCHAR AS original_message, 'EMPTY' AS error, '2024-02-01T00:00:00Z' AS timestamp FROM conversations")
def dlq_envelope(spark, sf_dir):
    return sinks.dead_letters(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), F.lit("EMPTY"), now())


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value::DECIMAL(18, 4))::DOUBLE AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    from newsloom.streaming import flows

    e = events(spark, sf_dir).withColumn("value", F.col("value").cast("decimal(18,4)"))
    t = flows.tumbling(e, "ts", "1 hour", "2 hours", "event_type")
    return t.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.col("total").cast("double"))


@query("""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def events_session(spark, sf_dir):
    from newsloom.streaming import flows

    s = flows.sessions(events(spark, sf_dir), "user_id")
    return s.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("SELECT doc_id, 'Summary of: ' || split_part(text, chr(10), 1) AS ai_summary, 'default' AS ai_summary_model FROM documents")
def summary_processor(spark, sf_dir):
    return Summarizer({"endpoint": "local"}).apply(articles(spark, sf_dir)).select(F.col("arrival").alias("doc_id"), "ai_summary", "ai_summary_model")


@query("SELECT 'ws_wss_a.example_news' AS feed_id, 'websocket' AS feed_type UNION ALL SELECT 'ws_ws_b.example', 'websocket'")
def socket_feeds(spark, sf_dir):
    from newsloom.plugins import SocketSource

    return SocketSource({"websocket_urls": ["wss://a.example/news", "ws://b.example"]}).feeds(spark).select("feed_id", "feed_type")


@query("SELECT source, quality, toxic, count(*) AS articles FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def quality_by_source(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    return d.join(read(spark, sf_dir, "labels"), "doc_id").groupBy("source", "quality", "toxic").agg(F.count(F.lit(1)).alias("articles"))


@query(SQL["dedup_first_wins"])
def stream_dedup(spark, sf_dir):
    """Documents as micro-batches through the stateful dedup; the same rows as dedup_first_wins."""
    import uuid

    from newsloom.lineage import shared_dir
    from newsloom.streaming import flows

    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = read(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*")
    rows = pipeline.from_documents(stream).select("arrival", "title", "body", F.lit(True).alias("publishable"))
    job = flows.DedupStream(f"{root}/state", f"{root}/out")
    job.start(rows, f"{root}/checkpoint").awaitTermination()
    return job.result(spark).select(F.col("arrival").alias("doc_id"), "is_duplicate")
