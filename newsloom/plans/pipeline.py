"""The article dataflow: evaluate, drop near-duplicates first-wins, split by status, count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.lineage import checkpointed
from newsloom.operators import dedup, evict, metrics, normalize, rules
from newsloom.schema import ARTICLE


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents as articles: the first line is the title; id order is arrival order."""
    first = F.regexp_extract("text", r"^[^\n]*", 0)
    link = F.concat(F.lit("https://"), F.coalesce("source", F.lit("none")), F.lit(".example.com/a/"), F.col("doc_id"), F.lit("?utm_source=feed&id="), F.col("doc_id"))
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 3600)
    given = {"title": first, "body": F.col("text"), "url": link, "canonical_url": F.regexp_extract(link, r"^[^?]*", 0), "published_at": at, "source": F.col("source"), "extraction_method": F.lit("document")}
    columns = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ARTICLE.fields]
    return docs.select(*columns, F.col("doc_id").alias("arrival"), F.col("doc_id").cast("string").alias("article_key"))


@dataclass
class Result:
    status: DataFrame
    messages: DataFrame
    rejects: DataFrame
    jobs: DataFrame
    #: feed_id and error of feeds that gave no article
    failures: DataFrame | None = None
    #: names what is written of it, so that writing twice is writing once
    run_id: str = ""


def signed_for_dedup(articles: DataFrame) -> DataFrame:
    """arrival, signature, publishable of evaluated articles with status or publishable."""
    return dedup.signatures(articles.select("arrival", "title", "body", "publishable")).select("arrival", "signature", "publishable")


def with_status(articles: DataFrame, as_of: Column, store: DataFrame | None = None, places: int | None = None) -> DataFrame:
    """Evaluated articles with status published, duplicate, invalid or error; duplicate comes before invalid.

    store and places: what earlier runs have left of the dedup store, and its size. Without places all articles are remembered.
    """
    e = rules.evaluate(articles, as_of)
    makes = F.length(F.coalesce("language", "lang_code")) == 2
    # written, as both the signatures and what is made of the decisions read it
    e = checkpointed(e.withColumn("publishable", F.col("is_valid") & F.coalesce(makes, F.lit(False))))
    signed = signed_for_dedup(e)
    dups = dedup.first_wins(signed) if places is None else evict.bounded_first_wins(signed, places, store=store)
    status = F.when(F.col("is_duplicate"), "duplicate").when(~F.col("is_valid"), "invalid").when(~F.col("publishable"), "error").otherwise("published")
    return e.join(dups, "arrival").withColumn("status", status)


def run(articles: DataFrame, as_of: Column, job_id: str = "job", store: DataFrame | None = None, places: int | None = None) -> Result:
    s = with_status(articles, as_of, store, places).withColumn("job_id", F.lit(job_id))
    return Result(
        s, normalize.messages(s.filter("status = 'published'"), as_of, job_id), s.filter("status IN ('invalid', 'error')"), metrics.job_counters(s.withColumn("job", F.col("source")), "job")
    )
