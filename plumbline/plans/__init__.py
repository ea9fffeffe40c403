"""Registered queries of the library's own operators."""

from . import content, graphs, latency, resources, scores, series, slo, spans, verdicts
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "content", "graphs", "latency", "resources", "scores", "series", "slo", "spans", "verdicts"]
