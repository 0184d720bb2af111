"""All registered queries.  Importing a module registers its queries."""

from keytempo.plans import (  # noqa: F401
    baseline_queries,
    event_queries,
    quality_queries,
    record_queries,
    stored_queries,
    stream_queries,
)
from keytempo.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
