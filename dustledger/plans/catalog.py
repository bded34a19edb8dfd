"""Imports every query module so that the registry is complete."""

from dustledger.plans.registry import ORACLES, QUERIES
from dustledger.plans import (  # noqa: F401
    q_decision, q_economics, q_ingest, q_rings, q_series, q_spatial, q_stats, q_telemetry,
)

__all__ = ["ORACLES", "QUERIES"]
