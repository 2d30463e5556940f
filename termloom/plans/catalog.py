"""All queries of the library and their twins."""

from __future__ import annotations

from . import corpus_queries, file_queries, queries, reply_queries, term_queries  # noqa: F401 - register
from .oracle import ORACLE as _WRITTEN
from .registry import QUERIES, TWINS

ORACLE = {**_WRITTEN, **TWINS}
__all__ = ["ORACLE", "QUERIES"]
