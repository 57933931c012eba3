"""Operators for preparing training text."""

from .queries import ORACLES, QUERIES  # noqa: F401
