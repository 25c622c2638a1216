"""Tessella: a typed dataset algebra over Spark DataFrames."""

from tessella.session import get_session

__all__ = ["get_session"]
