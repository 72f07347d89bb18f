"""All registered queries."""

from waybill.plans.catalog import changing, integrity, reading, reporting  # noqa: F401
from waybill.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
