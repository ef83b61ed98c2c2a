"""Tabular analytics over record tables, people tables in particular, as Spark DataFrame functions."""

from rollbook.session import tuned_session
from rollbook.operators.facade import OpResult, run

__all__ = ["OpResult", "run", "tuned_session"]
