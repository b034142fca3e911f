"""Every query of the engine over the driver tables."""

from itemnorm.queries import assembly, edits, enrichment, matching, runs, scalars, tables, vectors  # noqa: F401
from itemnorm.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
