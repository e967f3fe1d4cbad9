"""All registered queries; importing a query module registers its queries."""

from . import (  # noqa: F401
    queries_checks,
    queries_curation,
    queries_functions,
    queries_review,
    queries_sources,
    queries_stats,
    queries_streaming,
    queries_traces,
    queries_worlds,
)
from .registry import ORACLES, QUERIES  # noqa: F401
