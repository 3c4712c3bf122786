"""The query surface, by subject."""

from emberline.plans import analytics, dataset, events, explain, hotspots, records, stream, workflow
from emberline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analytics", "dataset", "events", "explain", "hotspots", "records", "stream", "workflow"]
