"""All registered queries."""

from __future__ import annotations

from . import contents, library, memory, scans, search, streams, structures, texts  # noqa: F401  they register
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
