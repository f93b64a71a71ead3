"""Named queries over the supplied tables, each with its independent SQL check."""

from __future__ import annotations

from . import chapters, exchange, jobs, matching, neighbours, networks, relational, sleep, text

_MODULES = (sleep, neighbours, relational, jobs, chapters, text, networks, matching, exchange)


def all_queries() -> dict:
    found: dict = {}
    for m in _MODULES:
        found.update(m.QUERIES)
    return found


def all_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _MODULES:
        found.update(m.SQL)
    return found
