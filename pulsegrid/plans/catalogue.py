"""All registered queries."""

from pulsegrid.plans import (beat_queries, long_signal_queries, multivariate_queries, relational_queries, rhythm_queries,  # noqa: F401
                              signal_queries, source_queries, statistics_queries)
from pulsegrid.plans.registry import ORACLES, QUERIES  # noqa: F401
