"""Registered queries: each key pairs a Spark query with SQL giving the same rows."""

from paramloom.plans import fleets, learning, logs, parameter_space, runs, streams
from paramloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "fleets", "learning", "logs", "parameter_space", "runs", "streams"]
