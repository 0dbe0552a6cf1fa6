"""flowbook: contract cash-flow events as Spark DataFrame transformations.

A book of principal-at-maturity loan contracts (text lines or a table) plus
market data (risk-factor lines) and an analysis date become dated cash-flow
events with nominal, rate and accrued-interest state.  Every step is a
DataFrame -> DataFrame function built from Spark SQL expressions; the only
exchange on the contract side is one hash partitioning by contract id.
"""

from flowbook.plans.pipeline import cashflow_events, run  # noqa: F401

__all__ = ["cashflow_events", "run"]
