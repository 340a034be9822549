"""All registered queries."""

from storyflow.plans import books, chapters, forums, inventory, markup, metadata, remaining, shelves, sites, streams, structure, values  # noqa: F401
from storyflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
