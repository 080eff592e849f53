"""Imports every query module, filling the registry."""

from fintrail.plans import (  # noqa: F401
    q_events, q_features, q_graph, q_models, q_paths, q_risk, q_streams, q_timeline, q_twin)
from fintrail.plans.registry import ORACLES, QUERIES  # noqa: F401
