"""All registered queries of the library's own operators, and their SQL twins."""

from __future__ import annotations

from . import answers, identity_queries, lists, pages, ranks, relational, scores, states, texts  # noqa: F401  registering
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
