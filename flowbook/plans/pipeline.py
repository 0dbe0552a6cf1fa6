"""Contracts to events: the user-level functions.

Plan shape (checked with ``explain``): text scan -> parse (one projection) ->
left joins to the per-code factor metadata (broadcast when its size check
passes) -> ONE hash exchange of the contracts on their line key -> generate
the event array and explode it -> broadcast as-of join for reset rows ->
windows by line (no further exchange: the partitioning is reused)
-> events.  Nesting groups by ``contract_id`` on the same partitioning.
Shuffling contracts before the explode moves one compact row per contract,
not ~13 event rows.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowbook.functions import parsing as P
from flowbook.operators import assemble, contracts as C, factors as FX, schedule, skew, state
from flowbook.sources import text

EVENT_OUTPUT = ["contract_id", "event_date", "seq", "type", "currency", "value", "nominal",
                "accrued", "reported"]


def _t0_col(t0) -> Column:
    return F.lit(text.to_date_value(t0))


def hot_codes(contracts: DataFrame, factors: FX.FactorTables | None) -> dict[str, skew.HotKeys | None]:
    """Frequent reset and scaling codes of the book; measured only where lookups shuffle."""
    if factors is None or factors.broadcast:
        return {"rr": None, "sc": None}
    return skew.measure(contracts, rr=F.col("rr_moc"), sc=F.col("sc_moc"))


def counters(layout: str = "full") -> dict[str, Column]:
    """P11, J5 as metrics of a valuation's contracts (after ``with_factors``): rejected
    lines by field, failed lookups of the others by use and status."""
    c = F.col
    ok = c("err_pos").isNull()
    rr, sc = ok & c("rr_moc").isNotNull(), ok & c("sc_moc").isNotNull()
    bad = rr & ~c("rr_ok")
    lookups = {
        "reset:missing": bad & ~c("rr_found"), "reset:unreadable": bad & c("rr_found"),
        "scaling:skipped": sc & bad, "scaling:missing": sc & ~bad & ~c("sc_found"),
        "scaling:unreadable": sc & ~bad & c("sc_found") & ~c("sc_ok")}
    out = {f"reject:{name}": c("err_field") == name for _, name, _ in C.LAYOUTS[layout]} | lookups
    return {k: F.count_if(F.coalesce(v, F.lit(False))) for k, v in out.items()}


def with_factors(contracts: DataFrame, factors: FX.FactorTables | None, hot: dict[str, skew.HotKeys | None] | None = None) -> DataFrame:
    """J2, J3, J5, F1-F3, F5, J8 on typed contracts.

    Adds ``rr_found, rr_ok, rr_type, rr_first, rr_last, rr_last_value,
    rr_curve_rate`` and the gated scaling lookup ``sc_found, sc_ok, sc_type,
    sc_first, sc_last, sc_last_value``.
    """
    if factors is None:
        empty = []
        for p in ("rr", "sc"):
            empty += [F.lit(False).alias(f"{p}_found"), F.lit(None).cast("string").alias(f"{p}_type"),
                      F.lit(None).cast("date").alias(f"{p}_first"), F.lit(None).cast("date").alias(f"{p}_last"),
                      F.lit(None).cast("double").alias(f"{p}_last_value"), F.lit(False).alias(f"{p}_ok")]
        return contracts.select("*", *empty, F.lit(None).cast("double").alias("rr_curve_rate"))
    hot = hot or hot_codes(contracts, factors)
    out = FX.lookup_code(contracts, factors, "rr_moc", "rr", hot=hot["rr"])
    gate = F.col("rr_moc").isNull() | F.col("rr_ok")
    out = FX.lookup_code(out, factors, "sc_moc", "sc", gate=gate, ok="scaling_ok", hot=hot["sc"])
    curve = F.when(F.col("rr_type") == FX.TERM_STRUCTURE, F.col("rr_moc"))
    names = out.columns
    cut = out.select("*", P.period_parts(F.col("rr_term")).alias("_term"))
    return FX.with_curve_rate(cut, factors, curve, P.years_of(F.col("_term")), "rr_curve_rate", hot=hot["rr"]).select(*names, "rr_curve_rate")


def cashflow_events(t0, factors: FX.FactorTables | None = None, partitions: int | None = None,
                    repartition: bool = True, keep: tuple[str, ...] = (), observe: Observation | None = None) -> Callable[[DataFrame], DataFrame]:
    """``contracts.transform(cashflow_events(t0, factors))`` -> flat events.

    ``contracts`` are typed terms (``parse_contracts`` output or a table); rows
    with ``err_pos`` set generate no events.

    Output columns ``contract_id, event_date DATE, seq, type, currency, value,
    nominal, accrued, reported`` (+ ``keep``), all events from IED on, so state
    before t0 is built; filter ``reported`` for what the reference reports.

    ``repartition=False`` when the contracts are already hash partitioned by
    ``contract_id`` (a bucketed table): then the plan has no exchange at all.
    ``observe`` gets the ``counters`` when an action runs the valuation.
    """
    t0c = _t0_col(t0)

    def spread(df: DataFrame) -> DataFrame:
        # An explicit count: AQE would coalesce this small shuffle (one row per
        # contract) to a few partitions, but every row becomes ~10-20 events
        # and window work after it, so the shuffle size understates the stage.
        if not repartition:
            return df
        n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(n, state.LINE_KEY)  # unique: no hot key, NULL ids spread too

    def apply(contracts: DataFrame) -> DataFrame:
        if state.LINE_KEY not in contracts.columns:
            contracts = contracts.select("*", F.monotonically_increasing_id().alias(state.LINE_KEY))
        # Broadcast lookups are narrow, so run them after the exchange (in
        # parallel, whatever the input split count).  Shuffle lookups re-key
        # the contracts by code first; then the exchange by id comes last.
        hot = hot_codes(contracts, factors)
        if factors is None or factors.broadcast:
            df = with_factors(spread(contracts), factors, hot)
        else:
            df = spread(with_factors(contracts, factors, hot))
        if observe is not None:
            df = df.observe(observe, *[v.alias(k) for k, v in counters().items()])
        df = state.with_amounts(df).select("*", (F.col("rr_type") == FX.REFERENCE_RATE).alias("_rr_series"), (F.col("rr_type") == FX.TERM_STRUCTURE).alias("_rr_curve"))
        ev = schedule.explode_events(df, t0c)
        is_series_reset = (F.col(schedule.KIND) == schedule.EVENT_RANK["RR"]) & F.col("_rr_series")
        if factors is not None:
            ev = FX.asof_value(ev, factors, F.when(is_series_reset, F.col("rr_moc")), F.col("obs_date"),
                               F.col("rr_first"), F.col("rr_last"), F.col("rr_last_value"),
                               "_series_value", hot=hot["rr"])
        else:
            ev = ev.select("*", F.lit(None).cast("double").alias("_series_value"))
        obs = (F.when(F.col("_rr_curve"), F.col("rr_curve_rate"))
               .when(is_series_reset, F.col("_series_value")))
        ev = ev.select("*", obs.alias("obs_value"))
        rolled = state.roll_state(ev, t0c)
        return rolled.select(*EVENT_OUTPUT, *keep, state.LINE_KEY)

    return apply


def to_base_currency(events: DataFrame, factors: FX.FactorTables, base: str = "USD",
                     prefix: str = "FX_") -> DataFrame:
    """``fx_rate`` (units of ``base`` per unit of the event currency, as of
    the event date, from the series ``prefix || currency``) and ``value_usd``.
    The base currency converts at 1."""
    hot = None if factors.broadcast else skew.measure(events, key=F.when(F.col("currency") != base, F.concat(F.lit(prefix), F.col("currency"))))["key"]
    m = factors.meta.select(F.col("code").alias("_fx_code"), F.col("first_date").alias("_fx_first"),
                            F.col("last_date").alias("_fx_last"), F.col("last_value").alias("_fx_lv"))
    code = F.when(F.col("currency") != base, F.concat(F.lit(prefix), F.col("currency")))  # base rows look nothing up
    ev = FX.join_meta(events, factors, m, code, "_fx_code", hot)
    ev = FX.asof_value(ev, factors, F.col("_fx_code"), F.col("event_date"), F.col("_fx_first"),
                       F.col("_fx_last"), F.col("_fx_lv"), "_fx", hot=hot)
    rate = F.when(F.col("currency") == base, F.lit(1.0)).otherwise(F.col("_fx"))
    keep = [c for c in ev.columns if c not in ("_fx_code", "_fx_first", "_fx_last", "_fx_lv", "_fx")]
    return ev.select(*keep, rate.alias("fx_rate"), (F.col("value") * rate).alias("value_usd"))


def parse_book(lines: DataFrame, layout: str = "full") -> DataFrame:
    """P1-P15 on contract lines: typed terms with error columns."""
    return C.parse_contracts(lines, layout=layout)


def ingest_contracts(lines: DataFrame, table: str, buckets: int, path: str | None = None,
                     layout: str = "full") -> DataFrame:
    """Parse a contract book once and store it bucketed by ``contract_id``.

    Valuation runs (any t0, any market data) then read the table with its
    hash partitioning known to the planner and use
    ``cashflow_events(..., repartition=False)``: no exchange at all, the
    one-time shuffle is paid here.  ``path`` (default: under the shared
    ``spark.checkpoint.dir``) makes it an external table.
    """
    from flowbook.plans import sinks

    spark = lines.sparkSession
    book = C.parse_contracts(lines, layout=layout)
    loc = path or f"{sinks.shared_dir(spark)}/flowbook-book-{table}"
    (book.write.mode("errorifexists").bucketBy(buckets, "contract_id").sortBy("contract_id")
     .option("path", loc).saveAsTable(table))
    return spark.table(table)


def load_factors(spark: SparkSession, path: str | list[str]) -> FX.FactorTables:
    """L4: read the factor file(s) into typed, size-checked lookup tables."""
    return FX.FactorTables(text.read_lines(spark, path))


#: Bytes of event rows made from a byte of contract text (about 14 events of 120 bytes
#: from a line of 280), and the bytes a partition should hold.
EVENT_BYTES_PER_LINE_BYTE, PARTITION_BYTES = 6, 64 << 20


def partitions_for(spark: SparkSession, path: str | list[str]) -> int:
    """H2: partitions for the events of the contract files at ``path``, by their size;
    the session's parallelism at least."""
    need = -(-text.input_bytes(spark, path) * EVENT_BYTES_PER_LINE_BYTE // PARTITION_BYTES)
    return max(need, spark.sparkContext.defaultParallelism)


def run(spark: SparkSession, contracts_path: str | list[str] | None = None, *,
        lines: DataFrame | None = None, factors_path: str | list[str] | None = None,
        factor_lines: DataFrame | None = None, t0=None, time_spec_path: str | None = None,
        layout: str = "full", partitions: int | str | None = None, min_partitions: int | None = None,
        sink: str | None = None, output: str | None = None, view: str | None = None,
        cache: bool = False, release: bool | None = None, compression: str | None = None) -> DataFrame:
    """L1-L3 in one function; returns the nested result (one row per contract).

    L1: ``run(spark, c, factors_path=f, time_spec_path=t, sink='text', output=o)``
    L2: ``run(spark, c, factors_path=f, time_spec_path=t, partitions=n, sink='parquet',
        output=o, view='events', cache=True)``
    L3: ``run(spark, c, layout='short', t0='2015-04-01T00', sink='text', output=o)``

    ``partitions`` defaults to ``partitions_for`` the contract files.  ``release``
    (default: with the parquet sink) removes the intermediate tables once the sink is
    written and returns, caches and registers what was written.  ``compression`` is of
    the text sink's files.
    """
    from flowbook.plans import sinks

    since = sinks.mark()
    if partitions is not None:  # H2: also given as text such as "32" or "32.0", truncated
        partitions = int(float(partitions))
    elif contracts_path is not None:
        partitions = partitions_for(spark, contracts_path)
    if lines is None:
        lines = text.read_lines(spark, contracts_path, min_partitions=min_partitions)
    if t0 is None:
        t0 = (text.read_analysis_date(spark, time_spec_path) if time_spec_path
              else _dt.date(2015, 4, 1))
    if factor_lines is None and factors_path is not None:
        factor_lines = text.read_lines(spark, factors_path)
    factors = FX.FactorTables(factor_lines) if factor_lines is not None else None
    nested = assemble.nest(parse_book(lines, layout).transform(cashflow_events(t0, factors, partitions=partitions)))
    release = sink == "parquet" if release is None else release and sink is not None
    if cache and not release:
        nested = nested.persist()
    try:
        if sink == "text":
            sinks.write_text(nested, output, compression)
        elif sink == "parquet":
            sinks.write_parquet(nested, output)
    finally:
        if release:
            sinks.release(spark, since)
    if release:
        nested = spark.read.schema(nested.schema).parquet(output) if sink == "parquet" else sinks.read_text(spark, output)
        nested = nested.persist() if cache else nested
    if view:
        nested.createOrReplaceTempView(view)
    return nested
