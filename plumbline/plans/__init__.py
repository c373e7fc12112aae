from plumbline.plans import budgets, contracts, files, frontier, inference, mixtures, projections, quality, scaling  # noqa: F401
from plumbline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
