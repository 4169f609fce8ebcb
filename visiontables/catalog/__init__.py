"""The named queries: importing a module registers what it holds."""

from visiontables.catalog import geometry, lifecycles, masks, overlaps, shapes, texts, tracking, workflows  # noqa: F401
from visiontables.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
