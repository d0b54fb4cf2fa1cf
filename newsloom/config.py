"""Settings, from the environment where it names them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from functools import lru_cache

from newsloom.errors import ConfigError

#: Levels, environments, and the names and defaults of settings.
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
ENVIRONMENTS = ("development", "staging", "production")


@dataclass(frozen=True)
class Settings:
    crawl_interval_minutes: int = 30
    request_timeout_seconds: int = 10
    retry_backoff_seconds: int = 30
    max_retries: int = 5
    lang_conf_threshold: float = 0.8
    schema_version: str = "v1.0"
    message_topic: str = "news_raw"
    dead_letter_topic: str = "news_raw_dlq"
    circuit_breaker_failure_threshold: int = 3
    circuit_breaker_timeout_minutes: int = 10
    dedup_cache_size: int = 10_000
    dedup_ttl_hours: int = 24
    log_level: str = "INFO"
    environment: str = "development"
    app_name: str = "newsloom"
    app_version: str = "1.0.0"

    def __post_init__(self) -> None:
        if self.log_level.upper() not in LEVELS:
            raise ConfigError(f"log_level must be one of {LEVELS}", field="log_level")
        if self.environment.lower() not in ENVIRONMENTS:
            raise ConfigError(f"environment must be one of {ENVIRONMENTS}", field="environment")
        if not 0 <= self.lang_conf_threshold <= 1:
            raise ConfigError("lang_conf_threshold must be in [0, 1]", field="lang_conf_threshold")

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(f.name.upper())
            if raw is not None:
                try:
                    given[f.name] = type(f.default)(raw)
                except ValueError as e:
                    raise ConfigError(f"{f.name}: {e}", field=f.name) from e
        return cls(**given)


@lru_cache(maxsize=1)
def settings() -> Settings:
    return Settings.from_env()
