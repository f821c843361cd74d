"""Log lines for machines (a JSON object each) or for people, set up with the standard library's own configuration.

The context of a line is whatever the caller passed as ``extra``: a record's attributes beyond those that any
record has.
"""

from __future__ import annotations

import json
import logging
import logging.config
import time
from typing import TextIO

#: What each line says, and how a record tells it. Entries that a record has nothing for are left out.
FIELDS = {
    "timestamp": lambda r: logging.Formatter.formatTime(_CLOCK, r, "%Y-%m-%dT%H:%M:%S") + f".{int(r.msecs):03d}+00:00",
    "level": lambda r: r.levelname,
    "logger": lambda r: r.name,
    "message": lambda r: r.getMessage(),
    "context": lambda r: {k: r.__dict__[k] for k in sorted(r.__dict__.keys() - _USUAL)},
    "exception": lambda r: _CLOCK.formatException(r.exc_info) if r.exc_info else None,
}
_CLOCK = logging.Formatter()
_CLOCK.converter = time.gmtime
_USUAL = {*logging.LogRecord("", 0, "", 0, "", None, None).__dict__, "message", "asctime", "line"}


def told(record: logging.LogRecord) -> bool:
    """A filter that passes every record and writes its JSON into ``line``."""
    values = {name: of(record) for name, of in FIELDS.items()}
    record.line = json.dumps({k: v for k, v in values.items() if v not in (None, {})}, ensure_ascii=False, default=str)
    return True


class _Line(logging.Formatter):
    """A record's line as it is: what was raised is in it already."""

    def format(self, record: logging.LogRecord) -> str:
        return record.line


def configure(level: str = "INFO", as_json: bool = True, stream: TextIO | None = None) -> None:
    """Sends records of a level and above to ``stream`` (standard error if none), in place of earlier handlers.

    The names of levels are the standard library's, in any case; another name is a ValueError.
    """
    shown = {"()": _Line} if as_json else {"format": "{asctime} {levelname:<8} {name}: {message}", "style": "{"}
    logging.config.dictConfig({
        "version": 1, "disable_existing_loggers": False, "formatters": {"shown": shown}, "filters": {"told": {"()": lambda: told}},
        "handlers": {"out": {"class": "logging.StreamHandler", "formatter": "shown", "filters": ["told"] if as_json else [], **({"stream": stream} if stream else {})}},
        "root": {"handlers": ["out"], "level": level.upper()},
    })
