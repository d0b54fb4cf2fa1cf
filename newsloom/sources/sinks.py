"""Sinks for messages and dead letters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import times


@dataclass(frozen=True)
class Topic:
    """Where messages go: a topic of a broker if its connector is there, else a folder of files."""

    name: str
    partitions: int
    retention_days: int
    compression: str = "snappy"
    max_bytes: int = 10 << 20


MESSAGES = Topic("news_raw", 6, 30)
DEAD_LETTERS = Topic("news_raw_dlq", 3, 90)


def keyed(messages: DataFrame, key: str = "article_id") -> DataFrame:
    return messages.select(F.col(key).alias("key"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def publish(messages: DataFrame, topic: Topic, root: str, run: str, key: str = "article_id") -> str:
    """Writes key and value to the run's folder in the topic, dealt by key as a broker would; a retry of the run replaces what is there. Returns the path."""
    path = f"{root}/{topic.name}/run={run}"
    keyed(messages, key).repartition(topic.partitions, "key").write.mode("overwrite").option("compression", topic.compression).parquet(path)
    return path


def keep(rows: DataFrame, name: str, root: str, run: str) -> str:
    """The same for rows of any other table."""
    path = f"{root}/{name}/run={run}"
    rows.write.mode("overwrite").parquet(path)
    return path


def dead_letters(rejects: DataFrame, error: Column, as_of: Column, original: tuple[str, ...] = ("*",)) -> DataFrame:
    """An envelope with the original (all columns, or those named), the error and the time it was rejected."""
    return rejects.select(F.to_json(F.struct(*original), {"ignoreNullFields": "false"}).alias("original_message"), error.alias("error"), times.to_iso(as_of).alias("timestamp"))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def ensure_topics(spark: SparkSession, root: str, topics: tuple[Topic, ...] = (MESSAGES, DEAD_LETTERS)) -> dict[str, bool]:
    """Makes the folders of topics that lack one; which were made."""
    made = {}
    for t in topics:
        fs, path = _fs(spark, f"{root}/{t.name}")
        made[t.name] = not fs.exists(path) and fs.mkdirs(path)
    return made


def verify_topics(spark: SparkSession, root: str, topics: tuple[Topic, ...] = (MESSAGES, DEAD_LETTERS)) -> dict[str, bool]:
    found = {}
    for t in topics:
        fs, path = _fs(spark, f"{root}/{t.name}")
        found[t.name] = fs.exists(path)
    return found


def describe_topic(topic: Topic) -> dict[str, str]:
    """A topic's settings under the names that brokers use."""
    return {"partitions": str(topic.partitions), "retention.ms": str(topic.retention_days * 86_400_000), "compression.type": topic.compression, "max.message.bytes": str(topic.max_bytes)}


def sink_health(spark: SparkSession, root: str) -> bool:
    """Whether the sink's folder can be reached."""
    try:
        fs, path = _fs(spark, root)
        return bool(fs.exists(path))
    except Exception:  # a store that is down raises errors of its own kinds through the JVM
        return False
