"""All registered queries."""

from cohortline.plans import (  # noqa: F401
    basic_queries,
    case_control_queries,
    cohort_queries,
    statistics_queries,
    study_queries,
)
from cohortline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
