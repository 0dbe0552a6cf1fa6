"""Incremental valuation of contract files as they arrive (Structured Streaming).

The reference is batch only.  Contracts are independent of each other, so
the batch transformation applied to each micro-batch of new lines gives
exactly the batch result; this package only wires it to a file stream.
"""

from flowbook.streaming.incremental import start_contract_stream  # noqa: F401
