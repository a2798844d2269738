"""Usage metering, rating and ledger billing as Spark jobs.

Every function takes and returns DataFrames, so one definition of a step serves
both a batch job and a Structured Streaming query.
"""

from tallywork.session import build_session, configure

__all__ = ["build_session", "configure"]
