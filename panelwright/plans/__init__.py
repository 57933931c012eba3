"""Query catalogue over the order tables."""

from . import interval_queries, model_queries, panel_queries, study_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
