"""Schemas of articles, messages, feeds and operational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_map = T.MapType(T.StringType(), T.StringType(), False)


def _struct(spec: str, optional: str = "") -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampType(), "m": _map, "a": T.ArrayType(T.StringType())}
    null = set(optional.split())
    return T.StructType([T.StructField(n, kinds[k], n in null) for n, k in (x.split(":") for x in spec.split())])


#: The fields of the contract, and their kinds.
ARTICLE = _struct(
    "title:s body:s url:s canonical_url:s published_at:t author:s source:s language:s raw_html:s extraction_method:s article_id:s metadata:m",
    "published_at author source language raw_html article_id metadata",
)
MESSAGE = _struct(
    "article_id:s canonical_url:s title:s body:s url:s source:s language:s published_at:s crawled_at:s country:s checksum:s validation_score:d schema_version:s "
    "ingest_job_id:s publisher_id:s author:s raw_html:s extraction_method:s metadata:m",
    "country author raw_html",
)
FEED = _struct("feed_id:s name:s url:s feed_type:s enabled:b country:s language:s crawl_interval_minutes:i timeout_seconds:i headers:m metadata:m", "country language headers metadata")
RAW_DOCUMENT = _struct("feed_id:s url:s content:s content_type:s status:i fetched_at:t", "content content_type status fetched_at")
CRAWL_JOB = _struct("job_id:s feed_id:s started_at:s completed_at:s status:s articles_crawled:l articles_published:l articles_failed:l errors:a", "completed_at errors")
VALIDATION_LOG = _struct("record_id:s timestamp:t rule_id:s error_message:s severity:s schema_version:s feed_id:s job_id:s trace_id:s metadata:m", "feed_id job_id trace_id metadata")
ANOMALY_EVENT = _struct("event_id:s detected_at:t type:s description:s trace_id:s feed_id:s severity:s resolved:b resolved_at:t metadata:m", "trace_id feed_id resolved_at metadata")
DEAD_LETTER = _struct("original_message:s error:s timestamp:s")
HEALTH_CHECK = _struct("name:s status:s last_check:s error:s", "last_check error")

#: The tables of the catalog and what they are partitioned by.
TABLES = {"feed_sources": (FEED, ()), "crawl_jobs": (CRAWL_JOB, ("status",)), "data_validation_log": (VALIDATION_LOG, ("rule_id",)), "data_anomaly_events": (ANOMALY_EVENT, ("severity",))}


def message_contract() -> dict:
    """The message as an Avro record: its score is a 32-bit float on the wire."""

    def wire(f: T.StructField):
        kind = {"validation_score": "float", "metadata": {"type": "map", "values": "string"}}.get(f.name, "string")
        return {"name": f.name, "type": ["null", kind], "default": None} if f.nullable else {"name": f.name, "type": kind}

    return {"type": "record", "name": "NewsRaw", "fields": [wire(f) for f in MESSAGE.fields]}


def conforms(df: DataFrame, schema: T.StructType) -> list[str]:
    """Columns of schema that df lacks or has with another type."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [f.name for f in schema.fields if have.get(f.name) != f.dataType.simpleString()]
