"""New contract files -> nested events, one micro-batch at a time.

``foreachBatch`` runs the batch plan (parse, factor lookups, one exchange by
contract id, windows) on each micro-batch and writes the batch under
``epoch=<id>`` with overwrite, so a retried epoch replaces its own output
(exactly once with the checkpoint).  The factor tables are built once and
broadcast to every batch.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbook.operators import assemble
from flowbook.operators import factors as FX
from flowbook.plans import pipeline as PL
from flowbook.plans import sinks


def start_contract_stream(spark: SparkSession, contracts_dir: str, output: str, t0,
                          factor_lines: DataFrame | None = None, layout: str = "full",
                          checkpoint: str | None = None, available_now: bool = True,
                          max_files_per_trigger: int | None = None):
    """Start the stream; returns the ``StreamingQuery``.

    ``available_now=True`` processes what is there in bounded batches and
    stops (a scheduled job); ``False`` keeps watching ``contracts_dir``.
    """
    factors = FX.FactorTables(factor_lines) if factor_lines is not None else None
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = reader.load(contracts_dir)

    def process(batch: DataFrame, epoch: int) -> None:
        numbered = batch.select(F.monotonically_increasing_id().alias("line_no"), "value")
        book = PL.parse_book(numbered, layout)
        events = book.transform(PL.cashflow_events(t0, factors))
        nested = assemble.nest(events)
        nested.write.mode("overwrite").parquet(f"{output.rstrip('/')}/epoch={epoch}")

    name = hashlib.sha256(f"{contracts_dir}\n{output}".encode()).hexdigest()[:24]  # the same after a restart
    ckpt = checkpoint or f"{sinks.shared_dir(spark)}/flowbook-stream-{name}"
    writer = lines.writeStream.foreachBatch(process).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
