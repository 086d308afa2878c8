"""Scoring of streaming DataFrames."""

from featherloom.streaming import scoring

__all__ = ["scoring"]
