"""Registered queries: each applies operators to the stand-in tables, with its DuckDB twin beside it."""

from . import audits, clock, forward, joins, market, quality, scoring, streams, text, windows  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
