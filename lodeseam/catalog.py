"""Every query of the engine itself, by name, with its SQL twin where there is one."""

from __future__ import annotations

from lodeseam.plans import decisions, graphs, linking, retrieval, trials  # noqa: F401  each registers its queries
from lodeseam.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
