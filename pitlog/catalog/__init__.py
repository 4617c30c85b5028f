"""Named queries over the driver tables."""

from pitlog.catalog import (  # noqa: F401
    feature_queries,
    fit_queries,
    label_queries,
    model_queries,
    probability_queries,
    profile_queries,
    upkeep_queries,
)
from pitlog.catalog.registry import ORACLES, QUERIES  # noqa: F401
