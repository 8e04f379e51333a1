"""What the store writes to the log, and a set-up for programs that have none."""

from __future__ import annotations

import logging
import os

#: Names the level that a program starts with.
LEVEL = "GRIDLOOM_LOG"


def start(level: str | None = None) -> logging.Logger:
    """The package's logger, writing to standard error from ``level`` (else ``$GRIDLOOM_LOG``, else DEBUG) on.

    Further calls add nothing, and one without a level leaves it as it is; a program that
    has set up logging by itself keeps its handlers.
    """
    log = logging.getLogger("gridloom")
    if not log.hasHandlers():
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
    if level or log.level == logging.NOTSET:
        log.setLevel((level or os.environ.get(LEVEL) or "DEBUG").upper())
    return log
