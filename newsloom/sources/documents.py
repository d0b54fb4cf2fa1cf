"""Feed and page documents to articles. Everything but fetching is expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.errors import ParseError
from newsloom.functions import text, urls
from newsloom.sources.stretch import with_stretch

#: Content types of each parser.
TYPES = {"rss": ("application/rss+xml", "application/atom+xml", "text/xml", "application/xml"), "html": ("text/html", "application/xhtml+xml")}
#: Character references that are read.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
_ITEM = "title string, link string, description string, encoded string, author string, creator string, pubDate string, date string"
_ENTRY = "title string, link array<struct<_href string, _rel string>>, summary string, content string, published string, updated string, author struct<name string>"
FEED_XML = f"channel struct<item array<struct<{_ITEM.replace(' string', ': string')}>>>, entry array<struct<title: string, link: array<struct<_href: string, _rel: string>>, summary: string, content: string, published: string, updated: string, author: struct<name: string>>>"


def parser_for(content_type: Column) -> Column:
    """Exact types only, whatever the case; null for others."""
    low = F.lower(content_type)
    return F.when(low.isin(*TYPES["rss"]), "rss").when(low.isin(*TYPES["html"]), "html")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _date(c: Column) -> Column:
    """RFC 822 (the weekday is dropped; formatters refuse it) or ISO 8601."""
    plain = F.regexp_replace(_strip(c), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(plain, r"(GMT|UTC|UT|Z)$", "+0000")
    iso = F.when(c.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(_strip(c)))
    return F.coalesce(*[F.try_to_timestamp(zoned, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss")], iso)


def _first(*given: Column) -> Column:
    """The first that is not empty, then cleaned: precedence is that of raw values."""
    return text.clean_text(F.coalesce(*[F.when(g != "", g) for g in given], F.lit("")))


def feed_entries(docs: DataFrame, as_of: Column) -> DataFrame:
    """docs(feed_id, url, content): a row for each entry of RSS and Atom, in order, with error for those that make no article."""
    xml = docs.withColumn("_x", F.from_xml("content", FEED_XML, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}))
    rss = F.transform(
        F.coalesce(F.col("_x.channel.item"), F.array().cast(f"array<struct<{_ITEM.replace(' string', ':string')}>>")),
        lambda e: F.struct(
            _strip(e["title"]).alias("title"), _strip(e["link"]).alias("url"), _first(e["encoded"], e["description"]).alias("body"), _strip(F.coalesce(e["author"], e["creator"])).alias("author"),
            F.coalesce(_date(e["pubDate"]), _date(e["date"])).alias("published_at"),
        ),
    )
    atom = F.transform(
        F.coalesce(F.col("_x.entry"), F.array().cast("array<struct<title:string,link:array<struct<_href:string,_rel:string>>,summary:string,content:string,published:string,updated:string,author:struct<name:string>>>")),
        lambda e: F.struct(
            _strip(e["title"]).alias("title"), _strip(F.get(F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]).alias("url"),
            _first(e["content"], e["summary"]).alias("body"), _strip(e["author"]["name"]).alias("author"), F.coalesce(_date(e["published"]), _date(e["updated"])).alias("published_at"),
        ),
    )
    rows = xml.withColumn("_e", F.concat(rss, atom)).select("feed_id", F.posexplode_outer("_e").alias("entry", "_a"))
    none = F.col("_a").isNull()
    blank = lambda n: F.coalesce(F.col(f"_a.{n}"), F.lit("")) == ""
    error = F.when(none, "RSS_NO_ENTRIES").when(blank("title") | blank("url") | blank("body"), "RSS_BAD_ENTRY")
    return rows.select(
        "feed_id", "entry", F.col("_a.title").alias("title"), F.col("_a.body").alias("body"), F.col("_a.url").alias("url"), urls.key_url(F.col("_a.url")).alias("canonical_url"),
        F.coalesce("_a.published_at", F.when(~none, as_of)).alias("published_at"), F.when(F.col("_a.author") != "", F.col("_a.author")).alias("author"), F.col("feed_id").alias("source"),
        F.lit("rss").alias("extraction_method"), error.alias("error"),
    )


def feed_errors(entries: DataFrame) -> DataFrame:
    """feed_id, error: feeds whose entries or pages give no article at all."""
    counted = entries.groupBy("feed_id").agg(F.count_if(F.col("error").isNull()).alias("good"), F.min("error").alias("error"), F.count_if(F.col("error") == "RSS_NO_ENTRIES").alias("none"))
    named = F.when(F.col("none") > 0, "RSS_NO_ENTRIES").when(F.col("error") == "RSS_BAD_ENTRY", "RSS_NO_VALID_ARTICLES").otherwise(F.col("error"))
    return counted.filter("good = 0").select("feed_id", named.alias("error"))


def plain(html: Column) -> Column:
    """Text of a stretch of html: no tags, references read, white space as single spaces."""
    c = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " "))


def without_code(html: Column) -> Column:
    for p in (r"(?s)<!--.*?-->", r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>"):
        html = F.regexp_replace(html, p, " ")
    return html


def page_title(html: Column) -> Column:
    return plain(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def _meta(html: Column, *names: str) -> Column:
    """The content of the first <meta> with one of these names or properties, whichever attribute comes first; null if none has any."""
    found = []
    for name in names:
        own = rf"""(?:name|property|itemprop)\s*=\s*["']?{name}["']?"""
        for pattern in (rf"""(?is)<meta\s[^>]*?{own}[^>]*?\scontent\s*=\s*["']([^"']*)""", rf"""(?is)<meta\s[^>]*?\bcontent\s*=\s*["']([^"']*)["'][^>]*?\s{own}"""):
            found.append(F.nullif(_strip(plain(F.regexp_extract(html, pattern, 1))), F.lit("")))
    return F.coalesce(*found)


def page_author(html: Column) -> Column:
    byline = plain(F.regexp_extract(html, r"""(?is)<[a-z0-9]+\s[^>]*?(?:rel|class)\s*=\s*["']?(?:author|byline)["']?[^>]*>(.*?)</""", 1))
    return F.coalesce(_meta(html, "author", "article:author", "dc.creator"), F.nullif(F.regexp_replace(byline, r"(?i)^by\s+", ""), F.lit("")))


def page_date(html: Column) -> Column:
    given = _meta(html, "article:published_time", "datePublished", "pubdate", "date", "dc.date")
    time = F.nullif(F.regexp_extract(html, r"""(?is)<time\s[^>]*?datetime\s*=\s*["']?([^"'\s>]+)""", 1), F.lit(""))
    return F.coalesce(_date(given), _date(time))


def page_articles(pages: DataFrame, as_of: Column) -> DataFrame:
    """pages(url, html): title and body by the marked article, else by the densest stretch, else by the body without its frame; error if none has both."""
    code_free = without_code(F.col("html"))
    p = pages.withColumn("_h", code_free).withColumn("title", page_title(F.col("html")))
    marked = plain(F.regexp_extract("_h", r"(?is)<(?:article|main)(?:\s[^>]*)?>(.*)</(?:article|main)>", 1))
    body = F.col("_h")
    for tag in ("head", "nav", "header", "footer", "aside", "form"):
        body = F.regexp_replace(body, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>", " ")
    p = p.withColumn("_a", marked).withColumn("_b", plain(body))
    # only pages without marks go through the function
    p = with_stretch(p.withColumn("_unmarked", F.when(F.col("_a") == "", F.col("_h"))), "_unmarked", "_c")
    text_ = F.when(F.col("_a") != "", F.col("_a")).when(F.col("_c") != "", F.col("_c")).otherwise(F.col("_b"))
    bad = (F.coalesce("title", F.lit("")) == "") | (F.coalesce(text_, F.lit("")) == "")
    return p.select(
        *[c for c in pages.columns if c != "html"], "title", text_.alias("body"), urls.key_url(F.col("url")).alias("canonical_url"), F.coalesce(page_date(F.col("_h")), as_of).alias("published_at"), page_author(F.col("_h")).alias("author"),
        F.when(F.col("_a") != "", "marked").when(F.col("_c") != "", "dense").otherwise("whole").alias("extraction_method"), F.when(bad, "HTML_EXTRACTION_FAILED").alias("error"),
    )


#: Parsers by name: documents and a time to articles with error.
_PARSERS: dict[str, Callable[[DataFrame, Column], DataFrame]] = {
    "rss": feed_entries,
    "html": lambda docs, as_of: page_articles(docs.select("feed_id", "url", F.col("content").alias("html")), as_of),
}


def register_parser(name: str, parser: Callable[[DataFrame, Column], DataFrame]) -> None:
    """parser(docs, as_of) gives articles: feed_id, title, body, url, canonical_url, published_at, author, extraction_method, error and, if it has an order, entry."""
    if not callable(parser):
        raise ParseError(f"A parser must be callable, got {parser!r}", "PARSER_INVALID")
    _PARSERS[name.lower()] = parser


def unregister_parser(name: str) -> None:
    _PARSERS.pop(name.lower(), None)


def parsers() -> list[str]:
    return list(_PARSERS)


def parse(docs: DataFrame, as_of: Column) -> DataFrame:
    """Articles of dispatch()ed documents by all parsers, with the entry's place in its document, and error."""
    shared = ["feed_id", "title", "body", "url", "canonical_url", "published_at", "author", "extraction_method", "error"]
    out = None
    for name, parser in _PARSERS.items():
        found = parser(docs.filter(F.col("parser") == name), as_of)
        found = found.select(*shared, (F.col("entry") if "entry" in found.columns else F.lit(0)).cast("int").alias("entry"))
        out = found if out is None else out.unionByName(found)
    return out


def dispatch(docs: DataFrame) -> DataFrame:
    """parser by feed_type if there is one, else by content type; PARSER_UNKNOWN otherwise. What has an error already keeps it and gets no parser."""
    named = F.when(F.lower("feed_type").isin(*parsers()), F.lower("feed_type")) if "feed_type" in docs.columns else F.lit(None).cast("string")
    had = F.col("error") if "error" in docs.columns else F.lit(None).cast("string")
    chosen = F.when(had.isNull(), F.coalesce(named, parser_for(F.col("content_type"))))
    return docs.withColumn("parser", chosen).withColumn("error", F.coalesce(had, F.when(chosen.isNull(), "PARSER_UNKNOWN")))


def failures(feeds: DataFrame, docs: DataFrame, entries: DataFrame) -> DataFrame:
    """feed_id, error for feeds without any article: what reading, dispatch or parsing said of them, or NO_DOCUMENT."""
    read = docs.groupBy("feed_id").agg(F.max("error").alias("read"))
    none = feeds.select("feed_id").join(entries.filter("error IS NULL").select("feed_id").distinct(), "feed_id", "left_anti")
    found = none.join(read, "feed_id", "left").join(feed_errors(entries), "feed_id", "left")
    return found.select("feed_id", F.coalesce("read", "error", F.lit("NO_DOCUMENT")).alias("error"))
