"""Plugins: DataFrame-to-DataFrame steps with a lifecycle, kept in a registry."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.errors import ConfigError, NewsError
from newsloom.functions.text import socket_feed_id


class Kind(str, Enum):
    SOURCE = "source"
    FETCHER = "fetcher"
    PROCESSOR = "processor"
    TRANSFORMER = "transformer"


@dataclass(frozen=True)
class Metadata:
    name: str
    version: str
    kind: Kind = Kind.PROCESSOR
    description: str = ""
    author: str = ""
    dependencies: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.name or not self.version:
            raise ConfigError("A plugin needs a name and a version")


class Plugin:
    metadata: Metadata
    required: tuple[str, ...] = ()

    def __init__(self, config: dict | None = None) -> None:
        self.config, self.ready = dict(config or {}), False

    def validate(self) -> None:
        missing = [k for k in self.required if k not in self.config]
        if missing:
            raise ConfigError(f"{missing[0]!r} required in configuration", field=missing[0])

    def initialize(self) -> None:
        self.ready = True

    def shutdown(self) -> None:
        self.ready = False

    def healthy(self) -> bool:
        return self.ready

    def apply(self, df: DataFrame) -> DataFrame:
        return df


class Summarizer(Plugin):
    """Adds a summary column where an endpoint is configured; articles without content stay without one."""

    metadata = Metadata("summarizer", "1.0.0", Kind.PROCESSOR)

    def apply(self, df: DataFrame) -> DataFrame:
        if not self.config.get("endpoint"):
            return df
        has = F.coalesce("body", F.lit("")) != ""
        return df.withColumn("ai_summary", F.when(has, F.concat(F.lit("Summary of: "), F.col("title")))).withColumn("ai_summary_model", F.when(has, F.lit(self.config.get("model", "default"))))


class SocketSource(Plugin):
    metadata = Metadata("socket_source", "1.0.0", Kind.SOURCE)
    required = ("websocket_urls",)

    def feeds(self, spark: SparkSession) -> DataFrame:
        rows = spark.createDataFrame([(u,) for u in self.config["websocket_urls"]], "url string")
        return rows.select(socket_feed_id(F.col("url")).alias("feed_id"), F.concat(F.lit("WebSocket Feed: "), F.col("url")).alias("name"), "url", F.lit("websocket").alias("feed_type"))

    def accepts(self, feeds: DataFrame) -> DataFrame:
        return feeds.filter("feed_type = 'websocket'")


class RotatingProxies(Plugin):
    metadata = Metadata("rotating_proxies", "1.0.0", Kind.FETCHER)
    required = ("proxies",)

    def accepts(self, feeds: DataFrame) -> DataFrame:
        return feeds.filter(F.col("url").startswith("http://") | F.col("url").startswith("https://"))


@dataclass
class Plugins:
    """Registry and lifecycle together."""

    loaded: dict[str, Plugin] = field(default_factory=dict)

    def load(self, plugin: Plugin) -> Plugin:
        name = plugin.metadata.name
        if name in self.loaded:
            raise NewsError(f"Plugin {name} already registered", "PLUGIN_EXISTS")
        plugin.validate()
        plugin.initialize()
        self.loaded[name] = plugin
        return plugin

    def get(self, name: str) -> Plugin:
        if name not in self.loaded:
            raise NewsError(f"Plugin {name} not registered", "PLUGIN_NOT_FOUND")
        return self.loaded[name]

    def unload(self, name: str) -> None:
        self.get(name).shutdown()
        del self.loaded[name]

    def reload(self, name: str, config: dict) -> None:
        self.get(name).config = dict(config)

    def names(self) -> list[str]:
        return list(self.loaded)

    def metadata(self) -> list[Metadata]:
        return [p.metadata for p in self.loaded.values()]

    def of(self, kind: Kind) -> list[Plugin]:
        return [p for p in self.loaded.values() if p.metadata.kind is kind]

    def health(self) -> dict[str, bool]:
        return {n: p.healthy() for n, p in self.loaded.items()}

    def shutdown(self) -> None:
        for name in self.names():
            self.unload(name)
