"""The queries and their SQL, as the plans have registered them."""

from __future__ import annotations

from .plans import change_log, logs, reports, runs, scans, verification  # noqa: F401  they register their queries
from .plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
