"""All registered queries."""

from tablekit.plans import documents_json, formats, ledgers, places, quality, relational, streams  # noqa: F401
from tablekit.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
