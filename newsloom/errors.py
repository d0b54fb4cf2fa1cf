"""Errors of the engine: a message and a machine-readable code that the rejects frames carry."""

from __future__ import annotations


class NewsError(Exception):
    code = "CRAWLER_ERROR"

    def __init__(self, message: str, error_code: str | None = None, **detail) -> None:
        super().__init__(message)
        self.message, self.error_code, self.detail = message, error_code or self.code, detail

    def __str__(self) -> str:
        return f"[{self.error_code}] {self.message}"


def _kind(name: str, code: str) -> type[NewsError]:
    return type(name, (NewsError,), {"code": code, "__module__": __name__})


#: Codes of errors.
FetchError = _kind("FetchError", "FETCH_ERROR")
ParseError = _kind("ParseError", "PARSE_ERROR")
ValidationError = _kind("ValidationError", "VALIDATION_ERROR")
PublishError = _kind("PublishError", "PUBLISH_ERROR")
ConfigError = _kind("ConfigError", "CONFIG_ERROR")
SchemaError = _kind("SchemaError", "SCHEMA_ERROR")
CircuitBreakerOpenError = _kind("CircuitBreakerOpenError", "CIRCUIT_BREAKER_OPEN")
LanguageDetectionError = _kind("LanguageDetectionError", "LANGUAGE_DETECTION_ERROR")
DuplicateArticleError = _kind("DuplicateArticleError", "DUPLICATE_ARTICLE")
NormalizationError = _kind("NormalizationError", "NORMALIZATION_ERROR")
ALL = (NewsError, FetchError, ParseError, ValidationError, PublishError, ConfigError, SchemaError, CircuitBreakerOpenError, LanguageDetectionError, DuplicateArticleError, NormalizationError)
