"""txnrisk: payment-risk analytics on Spark DataFrames.

Sub-packages
------------
sources    readers/writers and the fixture views over the driver's test tables
functions  column-expression builders (validation, geodesy, scoring rules)
operators  DataFrame -> DataFrame operators (features, ledger, reports, ML, ...)
streaming  Structured Streaming jobs (stateful sender features, scoring, feedback)
plans      the registry of named queries and their DuckDB oracle SQL
"""

from txnrisk.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
