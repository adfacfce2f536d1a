"""All analytics queries; importing their modules registers them."""

from fieldloom.plans import cleaning, derived, gridding, inout, modelling, spatial  # noqa: F401
from fieldloom.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
