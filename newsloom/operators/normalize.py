"""Articles to messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text, times, urls
from newsloom.schema import MESSAGE


def messages(articles: DataFrame, as_of: Column, job_id: str = "job", publisher_id: str = "newsloom", schema_version: str = "v1.0", random_ids: bool = False) -> DataFrame:
    """One row of MESSAGE for each evaluated article that makes one.

    Ids come from the canonical URL, so that a replay writes the same ids; random_ids
    gives each message a new one. A language that is not two letters makes no message.
    """
    url = urls.canonical_url(F.col("url"))
    own = F.uuid() if random_ids else F.sha2(F.concat_ws("|", url, "article_key"), 256)
    language = F.lower(F.coalesce("language", "lang_code"))
    body = text.normalize_text(F.col("body"))
    given = {
        "article_id": F.coalesce("article_id", own), "canonical_url": url, "title": text.normalize_text(F.col("title")), "body": body, "url": F.col("url"), "source": F.col("source"),
        "language": language, "published_at": times.to_iso(F.col("published_at")), "crawled_at": times.to_iso(as_of), "country": text.country_of(F.col("metadata")),
        "checksum": text.sha256(body), "validation_score": F.col("validation_score"), "schema_version": F.lit(schema_version), "ingest_job_id": F.lit(job_id),
        "publisher_id": F.lit(publisher_id), "author": F.col("author"), "raw_html": F.lit(None).cast("string"), "extraction_method": F.col("extraction_method"),
        "metadata": F.transform_values(F.map_filter(F.coalesce("metadata", F.create_map(F.lit(""), F.lit(None).cast("string"))), lambda k, v: v.isNotNull()), lambda k, v: F.coalesce(v, F.lit(""))),
    }
    rows = articles.select(*[given[f.name].cast(f.dataType).alias(f.name) for f in MESSAGE.fields])
    return rows.filter(acceptable())


def acceptable() -> Column:
    """The checks that a message makes of itself."""
    return (F.length("language") == 2) & F.col("validation_score").between(0, 1) & times.valid_iso(F.col("published_at")) & times.valid_iso(F.col("crawled_at"))
