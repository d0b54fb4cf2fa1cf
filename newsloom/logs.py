"""Log records as JSON lines with a trace id."""

from __future__ import annotations

import json
import logging
import uuid
from contextvars import ContextVar
from datetime import UTC, datetime

_trace: ContextVar[str | None] = ContextVar("trace_id", default=None)


def trace_id() -> str:
    """The current trace id; a new one if there is none yet."""
    found = _trace.get()
    if found is None:
        found = uuid.uuid4().hex
        _trace.set(found)
    return found


def set_trace_id(value: str | None) -> None:
    _trace.set(value)


class JsonFormatter(logging.Formatter):
    own = frozenset(logging.makeLogRecord({}).__dict__) | {"message", "asctime", "taskName"}

    def format(self, record: logging.LogRecord) -> str:
        line = {
            "timestamp": datetime.fromtimestamp(record.created, UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "level": record.levelname, "logger": record.name, "message": record.getMessage(),
            "module": record.module, "function": record.funcName, "line": record.lineno, "trace_id": trace_id(),
        }
        line |= {k: v for k, v in record.__dict__.items() if k not in self.own}
        if record.exc_info:
            line["exception"] = self.formatException(record.exc_info)
        return json.dumps(line, default=str, ensure_ascii=False)


def configure(level: str = "INFO", stream=None) -> logging.Logger:
    """The package's logger, with one JSON handler."""
    log = logging.getLogger("newsloom")
    for old in log.handlers[:]:
        log.removeHandler(old)
    handler = logging.StreamHandler(stream)
    handler.setFormatter(JsonFormatter())
    log.addHandler(handler)
    log.setLevel(level.upper())
    log.propagate = False
    return log
