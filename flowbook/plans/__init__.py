"""Pipelines (L1-L4), sinks (K1-K6) and the registered queries."""
