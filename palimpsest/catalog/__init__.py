"""The registered queries, by domain."""

from palimpsest.catalog import evidence, history, observing, planning, requesting, streams, transcripts  # noqa: F401
from palimpsest.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
