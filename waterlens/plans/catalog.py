"""All registered queries of the library."""

from __future__ import annotations

from . import analyses, cards, checks, cleaning, conversions, floods, geometries, lines, links, maps, model, series, shapes, structures, variants  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
