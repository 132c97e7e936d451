"""All runnable queries. Importing a module registers its queries."""

from pitpanel.registered.base import ORACLES, QUERIES
from pitpanel.registered import evaluation, landing, models, panels, rules, scalars, tables  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
