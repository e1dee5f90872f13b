"""All queries over the engine's own operators, and their SQL."""

from __future__ import annotations

from opalgrid.plans import measures  # noqa: F401  isort: skip  they register themselves, the metrics first
from opalgrid.plans import boxes, extras, generators, matching, more, ranking  # noqa: F401
from opalgrid.plans.carrier import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
