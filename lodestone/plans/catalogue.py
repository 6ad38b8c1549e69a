"""The registered queries of the snapshot operators, and their SQL."""

from __future__ import annotations

from . import bundles, capture, comparison, governance, selection, structures, tagged
from .registry import ORACLE_SQL, QUERIES

flagship = governance.top1_cohort_customers

__all__ = ["ORACLE_SQL", "QUERIES", "bundles", "capture", "comparison", "flagship", "governance", "selection", "structures", "tagged"]
