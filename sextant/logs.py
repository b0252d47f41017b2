"""Log lines as JSON objects, one a line."""

from __future__ import annotations

import contextlib
import contextvars
import json
import logging
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

_correlation: contextvars.ContextVar[str | None] = contextvars.ContextVar("correlation", default=None)

_OWN = set(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


@contextlib.contextmanager
def correlated(ident: str | None = None) -> Iterator[str]:
    """Log lines within carry this id, a new one where none is given."""
    ident = ident or uuid.uuid4().hex
    token = _correlation.set(ident)
    try:
        yield ident
    finally:
        _correlation.reset(token)


class JsonLines(logging.Formatter):
    """timestamp, level, logger, message, correlation_id within ``correlated``, what ``extra`` adds, and the exception if there is one."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"timestamp": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if ident := _correlation.get():
            out["correlation_id"] = ident
        out |= {k: v for k, v in vars(record).items() if k not in _OWN}
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        return json.dumps(out, default=str, ensure_ascii=False)


def to_json(logger: str = "sextant", level: int = logging.INFO) -> logging.Handler:
    """Write a logger's lines as JSON to standard error, in place of its handlers."""
    h = logging.StreamHandler()
    h.setFormatter(JsonLines())
    log = logging.getLogger(logger)
    log.handlers, log.propagate = [h], False
    log.setLevel(level)
    return h
