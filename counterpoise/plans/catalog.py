"""All registered queries; importing the modules registers them."""

from counterpoise.plans import attributes, causal, language, reviews, storage, tables  # noqa: F401
from counterpoise.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
