"""Registered queries over the driver's tables."""

from . import energies, frames, live, more, series  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
