"""All registered queries; importing the parts fills the registry."""

from sitewise.plans import catalog_clients, catalog_cohort, catalog_jobs, catalog_metrics  # noqa: F401
from sitewise.plans import catalog_sources, catalog_stats  # noqa: F401
from sitewise.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
