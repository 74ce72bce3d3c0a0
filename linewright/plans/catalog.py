"""All registered queries."""

from linewright.plans import (  # noqa: F401  (importing registers)
    board_queries,
    decision_queries,
    document_queries,
    history_queries,
    log_queries,
    performance_queries,
)
from linewright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
