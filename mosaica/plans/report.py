"""What a preparation or a search tells of its progress, through the logger ``mosaica``.

Four levels: nothing; what took how long; also what begins, and with which parameters; also what came out in between.
"""

from __future__ import annotations

import logging
import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager
from enum import IntEnum
from typing import Any

log = logging.getLogger("mosaica")


class Level(IntEnum):
    NONE = 0
    BRIEF = 1
    INFO = 2
    FULL = 3


_level = Level.NONE


def tell(level: Level, stream=None) -> None:
    """From now on, report at ``level``; with a ``stream``, there too (``sys.stdout`` if the logger has no handler yet)."""
    global _level
    _level = Level(level)
    if _level and (stream is not None or not log.handlers):
        handler = logging.StreamHandler(stream or sys.stdout)
        handler.setFormatter(logging.Formatter("[mosaica] %(message)s"))
        log.addHandler(handler)
    if _level:
        log.setLevel(logging.INFO)


def clock(seconds: float) -> str:
    """``hh:mm:ss.mmm``."""
    millis = int(seconds * 1000)
    return f"{millis // 3_600_000:02d}:{millis // 60_000 % 60:02d}:{millis // 1000 % 60:02d}.{millis % 1000:03d}"


def warn(message: str, **full: Any) -> None:
    if _level:
        log.warning("%s%s", message, _listed(full) if _level >= Level.FULL else "")


def _listed(about: dict[str, Any]) -> str:
    return "".join(f", {k.replace('_', ' ')}: {v}" for k, v in about.items())


@contextmanager
def timed(what: str, begin: Level = Level.INFO, end: Level = Level.BRIEF, **about: Any) -> Iterator[dict[str, Any]]:
    """Reports the block's begin and, with its time, its end or failure, which is raised on.

    ``about`` is told with them from :attr:`Level.INFO` on. What the block puts into the dictionary under ``result`` is told at ``end``,
    all else at :attr:`Level.FULL`.
    """
    found: dict[str, Any] = {}
    more = _listed(about) if _level >= Level.INFO else ""
    if _level >= begin:
        log.info("%s began%s", what, more)
    began = time.time()
    try:
        yield found
    except Exception as e:
        if _level >= end:
            log.info("%s failed after %s%s: %s", what, clock(time.time() - began), more, str(e).split("\n")[0])
        raise
    if _level >= end:
        told = {k: v for k, v in found.items() if k == "result" or _level >= Level.FULL}
        log.info("%s took %s%s%s", what, clock(time.time() - began), more, _listed(told))
