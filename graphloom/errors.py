"""Errors of the engine: one exception with a code."""

from __future__ import annotations


class GraphError(Exception):
    """code is a stable name such as NOT_FOUND; the message says what was wrong."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code
