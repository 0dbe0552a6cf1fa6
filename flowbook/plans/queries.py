"""Registered queries: one per operator group of the survey, each reading the
driver's tables at ``sf_dir`` through the fixture derivation, plus the DuckDB
oracle for each (``flowbook.plans.oracle``)."""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowbook.functions import parsing as P
from flowbook.functions import sql as SF
from flowbook.functions.daycount import year_fraction
from flowbook.operators import assemble as A
from flowbook.operators import contracts as C
from flowbook.operators import factors as FX
from flowbook.operators import schedule as S
from flowbook.plans import pipeline as PL
from flowbook.plans import sinks as K
from flowbook.sources import fixtures as FXT
from flowbook.sources import text as TX

EARLY_T0 = _dt.date(1900, 1, 1)


def r4(x: Column) -> Column:
    """Four decimals, the same way in both engines (``round`` differs on halves)."""
    return F.floor(x * 10000 + 0.5) / F.lit(10000.0)


def book(spark: SparkSession, sf: str, layout: str = "full", defects: bool = False) -> DataFrame:
    return C.parse_contracts(FXT.contract_lines(FXT.load_book_source(spark, sf), layout, defects), layout)


def without_terms(df: DataFrame, rr: bool = True, prd_td: bool = True) -> DataFrame:
    """The book with the reset or purchase/termination terms switched off."""
    drop = dict(([] if rr else [("rr_anchor", "date"), ("rr_cycle", "string"), ("rr_moc", "string")]) +
                ([] if prd_td else [("prd", "date"), ("pprd", "double"), ("td", "date"), ("ptd", "double")]))
    if not drop:
        return df
    return df.select(*[F.lit(None).cast(drop[c]).alias(c) if c in drop else F.col(c) for c in df.columns])


def factors(spark: SparkSession, sf: str) -> FX.FactorTables:
    return FX.FactorTables(FXT.factor_lines(spark, FXT.load(spark, sf, "lineitem")))


def present(events: DataFrame) -> DataFrame:
    """Reported events, dates as text, doubles to four decimals."""
    return events.filter(F.col("reported")).select(
        "contract_id", F.col("event_date").cast("string").alias("event_date"), "seq", "type",
        "currency", r4(F.col("value")).alias("value"), r4(F.col("nominal")).alias("nominal"),
        r4(F.col("accrued")).alias("accrued"))


def event_partitions(spark: SparkSession, sf: str, books: int = 1) -> int:
    """H2: the session's shuffle partitions, and more for a large book (``books`` of them)."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), books * FXT.book_partitions(spark, sf))


def pam(spark: SparkSession, sf: str, t0=FXT.FIXTURE_T0, rr: bool = True, prd_td: bool = True,
        keep: tuple[str, ...] = (), f: FX.FactorTables | None = None, defects: bool = False) -> DataFrame:
    b = without_terms(book(spark, sf, defects=defects), rr=rr, prd_td=prd_td)
    if rr and f is None:
        f = factors(spark, sf)
    return b.transform(PL.cashflow_events(t0, f if rr else None, partitions=event_partitions(spark, sf), keep=keep))


def _text(df: DataFrame) -> DataFrame:
    """Dates as ISO text for comparison."""
    return df.select(*[F.col(c).cast("string").alias(c) if t == "date" else F.col(c)
                       for c, t in df.dtypes])


def q_pam_fixed(spark, sf):
    """Fixed rate, every event from IED on."""
    return present(pam(spark, sf, EARLY_T0, rr=False, prd_td=False))


def q_pam_running(spark, sf):
    """The same book cut at t0; running contracts carry their accrual."""
    return present(pam(spark, sf, rr=False, prd_td=False))


def q_pam_floating(spark, sf):
    """Resets from reference-rate series and a curve."""
    return present(pam(spark, sf, prd_td=False))


def q_pam_full(spark, sf):
    """E5 E6 X10 and everything above: the full book."""
    return present(pam(spark, sf))


def q_pam_defects(spark, sf):
    """The full book with bad lines; a rejected line has no event."""
    return present(pam(spark, sf, defects=True))


def q_nested_defects(spark, sf):
    """One row per input line, also for rejected lines (empty arrays) and
    for lines that share an id (here every line twice)."""
    b = without_terms(book(spark, sf, defects=True))
    n = A.nest(b.union(b).transform(PL.cashflow_events(FXT.FIXTURE_T0, factors(spark, sf), partitions=event_partitions(spark, sf, 2))))
    return n.select(F.size("id").alias("n_events"), r4(F.array_min("value")).alias("least"), r4(F.array_max("value")).alias("most"))


def _terms(df: DataFrame, layout: str = "full") -> DataFrame:
    names = [n for _, n, _ in C.LAYOUTS[layout]]
    return _text(df.select(*names, "err_pos"))


def q_parse_full(spark, sf):
    """The clean book read back from its text lines."""
    return _terms(book(spark, sf))


def q_parse_short(spark, sf):
    """The short layout (currency to notional one place to the right)."""
    return _terms(book(spark, sf, layout="short"), "short")


def q_parse_prefix(spark, sf):
    """P10: the book with bad rows; a bad term unsets itself and every later term."""
    return _terms(book(spark, sf, defects=True))


def q_parse_rejects(spark, sf):
    """One row per rejected line."""
    return C.rejects(book(spark, sf, defects=True))


def q_parse_reject_counts(spark, sf):
    """Rejects per field."""
    return C.rejects_by_field(book(spark, sf, defects=True))


def q_cycles(spark, sf):
    """Cycle and period texts split into count, unit and stub."""
    b = C.clean(book(spark, sf))
    ip, rr = F.col("ip_cycle"), F.col("rr_cycle")
    return b.select(
        "contract_id",
        P.cycle_n(ip).alias("ip_n"), P.cycle_unit(ip).alias("ip_unit"), P.cycle_stub(ip).alias("ip_stub"),
        P.cycle_is_long(ip).alias("ip_long"),
        P.cycle_n(rr).alias("rr_n"), P.cycle_unit(rr).alias("rr_unit"), P.cycle_stub(rr).alias("rr_stub"),
        P.cycle_is_long(rr).alias("rr_long"),
        P.period_n(F.col("rr_fixing")).alias("fixing_n"), P.period_unit(F.col("rr_fixing")).alias("fixing_unit"),
        P.period_years(F.col("rr_term")).alias("term_years"))


def _time_spec(spark, sf):
    return FXT.time_spec_lines(spark, FXT.load(spark, sf, "orders"))


def q_t0_tokens(spark, sf):
    """Every token of the time-spec lines."""
    return TX.analysis_date_tokens(_time_spec(spark, sf))


def q_analysis_date(spark, sf):
    """S3: the first non-empty token over all time-spec lines."""
    return _text(TX.analysis_date(_time_spec(spark, sf)))


def _factor_lines(spark, sf):
    return FXT.factor_lines(spark, FXT.load(spark, sf, "lineitem"))


def q_factor_points(spark, sf):
    """Every point of every known factor (series and curves)."""
    return _text(FX.factor_points(_factor_lines(spark, sf)))


def q_factor_rejects(spark, sf):
    """Factor lines that do not read as a whole."""
    return FX.factor_rejects(_factor_lines(spark, sf))


def q_factor_dedup(spark, sf):
    """One record per code, the later line wins."""
    d = FX.dedup(FX.factor_records(_factor_lines(spark, sf)))
    return d.select("code", "line_no", "rf_type", F.size("keys").alias("n_keys"))


def _with_factors(spark, sf):
    return PL.with_factors(C.clean(book(spark, sf)), factors(spark, sf))


def q_contract_factors(spark, sf):
    """Each contract's reset and scaling lookups."""
    return _with_factors(spark, sf).select(
        "contract_id", "rr_moc", "rr_found", "rr_ok", "rr_type", "sc_moc", "sc_found", "sc_ok",
        r4(F.col("rr_curve_rate")).alias("rr_curve_rate"))


def q_lookup_errors(spark, sf):
    """Codes a contract names that the factor file lacks (and skipped lookups)."""
    return FX.lookup_errors(_with_factors(spark, sf))


def q_curve_rate(spark, sf):
    """Each curve contract's remaining term at t0 read off its curve."""
    f = factors(spark, sf)
    b = FX.lookup_code(C.clean(book(spark, sf)), f, "rr_moc", "rr").filter(
        F.col("rr_type") == FX.TERM_STRUCTURE)
    term = F.datediff(F.col("md"), F.lit(FXT.FIXTURE_T0)).cast("double") / F.lit(365.0)
    out = FX.with_curve_rate(b, f, F.col("rr_moc"), term, "curve_rate")
    return out.select("contract_id", r4(term).alias("term_years"), r4(F.col("curve_rate")).alias("curve_rate"))


def q_asof_rate(spark, sf):
    """The observation behind every series or curve reset."""
    ev = pam(spark, sf, keep=("obs_date", "obs_value", "rr_moc"))
    return _text(ev.filter(F.col("type") == "RR").select(
        "contract_id", "event_date", "obs_date", F.col("rr_moc").alias("code"), "obs_value"))


def q_asof_index(spark, sf):
    """The scaling index at each reported event of contracts with an index."""
    f = factors(spark, sf)
    ev = pam(spark, sf, f=f, keep=("sc_moc", "sc_found", "sc_first", "sc_last", "sc_last_value"))
    ev = ev.filter(F.col("reported") & F.col("sc_found"))
    ev = FX.asof_value(ev, f, F.col("sc_moc"), F.col("event_date"), F.col("sc_first"), F.col("sc_last"),
                       F.col("sc_last_value"), "index_value", spread_key=F.col("contract_id"))
    return _text(ev.select("contract_id", "event_date", "seq", "type", "index_value"))


def q_asof_fx(spark, sf):
    """Each reported cash flow converted to USD at the FX rate of its date."""
    f = factors(spark, sf)
    ev = pam(spark, sf, f=f).filter(F.col("reported"))
    out = PL.to_base_currency(ev, f)
    return _text(out.select("contract_id", "event_date", "seq", "type", "currency", "fx_rate",
                            r4(F.col("value_usd")).alias("value_usd")))


def q_schedule(spark, sf):
    """Every generated event date of the full book, before state."""
    b = C.clean(book(spark, sf))
    return _text(S.schedule_table(b, F.lit(FXT.FIXTURE_T0)).select(
        "contract_id", "event_date", "seq", "type", "obs_date"))


def q_ip_schedule(spark, sf):
    """Interest payment dates per contract (cycle, stub rule, maturity)."""
    return q_schedule(spark, sf).filter(F.col("type") == "IP").select("contract_id", "event_date")


def q_rr_schedule(spark, sf):
    """Reset dates after t0, first one fixed (RRF), observation dates."""
    return q_schedule(spark, sf).filter(F.col("type").isin("RR", "RRF")).select(
        "contract_id", "event_date", "type", "obs_date")


def q_year_fraction(spark, sf):
    """IED to MD under the contract's convention and under each of the four."""
    b = C.clean(book(spark, sf))
    d1, d2 = F.col("ied"), F.col("md")
    return b.select(
        "contract_id", "dcc", year_fraction(d1, d2, F.col("dcc")).alias("yf"),
        year_fraction(d1, d2, F.lit("A/360")).alias("yf_a360"),
        year_fraction(d1, d2, F.lit("A/365")).alias("yf_a365"),
        year_fraction(d1, d2, F.lit("30E/360")).alias("yf_30e360"),
        year_fraction(d1, d2, F.lit("A/AISDA")).alias("yf_aisda"))


def nested(spark, sf) -> DataFrame:
    """G1-G4 on the full book, doubles to four decimals."""
    n = A.nest(pam(spark, sf))
    return n.select("id", "date", "type", "currency",
                    *[F.transform(c, r4).alias(c) for c in ("value", "nominal", "accrued")])


def q_events_nested(spark, sf):
    """One row per contract, seven parallel arrays."""
    return nested(spark, sf)


def q_events_flat(spark, sf):
    """The nested result back to one row per event."""
    return A.flatten(nested(spark, sf))


def q_events_text(spark, sf):
    """K1: the printable line per contract."""
    return K.row_text(nested(spark, sf), decimals=4)


def q_events_ids(spark, sf):
    """K6: the id projection as text."""
    return K.id_text(nested(spark, sf))


def q_events_parquet_roundtrip(spark, sf):
    """K2: nested result written as parquet to the shared folder and read back."""
    n = A.nest(pam(spark, sf))
    back = K.materialise(n, "events")
    flat = A.flatten(back)
    return flat.select("idx", "id", "date", "type", "currency",
                       *[r4(F.col(c)).alias(c) for c in ("value", "nominal", "accrued")])


def q_events_count(spark, sf):
    """K3 K4: COUNT(*) over the registered view = number of contracts."""
    nested(spark, sf).createOrReplaceTempView("events")
    return K.count_events_view(spark, "events")


def q_cash_by_currency_month(spark, sf):
    """K5: open SQL over a view of the flat events: cash per currency and month."""
    present(pam(spark, sf)).createOrReplaceTempView("events_flat")
    return spark.sql("""
        SELECT currency, substr(event_date, 1, 7) AS month, count(*) AS n_events,
               floor(sum(value) * 10000 + 0.5) / CAST(10000 AS DOUBLE) AS total_value,
               floor(sum(CASE WHEN type = 'IP' THEN value ELSE CAST(0 AS DOUBLE) END) * 10000 + 0.5)
                     / CAST(10000 AS DOUBLE) AS interest
        FROM events_flat GROUP BY currency, substr(event_date, 1, 7)""")


def files(spark, sf, defects: bool = False, names: tuple[str, ...] = FXT.FILES, compression: str = "none") -> dict[str, str]:
    """The fixture as text files in a new place of the shared folder."""
    return FXT.write_files(spark, sf, f"{K.shared_dir(spark)}/flowbook-files-{uuid.uuid4().hex}", defects, names, compression)


def _flat(n: DataFrame) -> DataFrame:
    return A.flatten(n).select("idx", "id", "date", "type", "currency", *[r4(F.col(c)).alias(c) for c in ("value", "nominal", "accrued")])


def q_run_text(spark, sf):
    """Contract, factor and time-spec files to a text sink; the
    sink's lines read back, one row per event.  All of these files are compressed: the
    sink's text takes 7 times as much disk otherwise."""
    f = files(spark, sf, names=("contracts", "factors", "time"), compression="gzip")
    out = f["contracts"] + "-out"
    PL.run(spark, f["contracts"], factors_path=f["factors"], time_spec_path=f["time"], min_partitions=16, sink="text", output=out, compression="gzip")
    return _flat(K.read_text(spark, out))


def q_run_parquet(spark, sf):
    """L2 H2 H3 K2 K3: the files to a parquet sink with the partition count as text, a
    cached view of the result, read through SQL."""
    f = files(spark, sf)
    PL.run(spark, f["contracts"], factors_path=f["factors"], time_spec_path=f["time"], partitions="32.0", sink="parquet",
           output=f["contracts"] + "-out", view="events_run", cache=True)
    return _flat(spark.sql("SELECT * FROM events_run"))


def q_run_short(spark, sf):
    """Files of the short layout valued at an analysis date given as text."""
    return _flat(PL.run(spark, files(spark, sf)["short"], layout="short", t0="1993-06-01T00"))


def q_load_factors(spark, sf):
    """The factor file loaded by type, one row per code."""
    m = PL.load_factors(spark, files(spark, sf)["factors"]).meta
    return _text(m.select("code", "rf_type", "first_date", "last_date", "last_value", F.size("curve").alias("n_tenors"), "reset_ok", "scaling_ok"))


def q_parse_files(spark, sf):
    """Text files with bad lines read by splits and parsed."""
    return _terms(C.parse_contracts(TX.read_lines(spark, files(spark, sf, defects=True)["contracts"])))


def q_time_spec_file(spark, sf):
    """S3: the analysis date of the time-spec files, in the order of their lines."""
    return _text(TX.analysis_date(TX.read_lines(spark, files(spark, sf)["time"])))


def q_parse_filtered(spark, sf):
    """Parsed terms of a filtered book; the filter does not enter the parser."""
    return _terms(book(spark, sf, defects=True).filter("dcc = 'A/360' AND (rr_moc = 'RATE_A' OR err_pos IS NOT NULL)"))


def q_observed_counts(spark, sf):
    """Rejects and failed lookups counted by the valuation itself, without another scan."""
    seen = Observation("valuation")
    b = book(spark, sf, defects=True)
    b.transform(PL.cashflow_events(FXT.FIXTURE_T0, factors(spark, sf), partitions=event_partitions(spark, sf), observe=seen)).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(k, n) for k, n in seen.get.items() if n], "metric string, n long")


def q_sql_functions(spark, sf):
    """Day counts and cycle dates as SQL functions over a view of the book."""
    SF.register(spark)
    C.clean(book(spark, sf)).createOrReplaceTempView("book")
    return spark.sql("""
        SELECT contract_id, fb_year_fraction(ied, md, dcc) AS yf, fb_year_fraction(ied, md, 'A/AISDA') AS yf_aisda,
               CAST(fb_cycle_date(ied, 2, ip_cycle) AS STRING) AS second_date, fb_role_sign(role) AS sign
        FROM book""")


QUERIES = {
    "parse_full": q_parse_full,
    "parse_short": q_parse_short,
    "parse_prefix": q_parse_prefix,
    "parse_rejects": q_parse_rejects,
    "parse_reject_counts": q_parse_reject_counts,
    "cycles": q_cycles,
    "t0_tokens": q_t0_tokens,
    "analysis_date": q_analysis_date,
    "factor_points": q_factor_points,
    "factor_rejects": q_factor_rejects,
    "factor_dedup": q_factor_dedup,
    "contract_factors": q_contract_factors,
    "lookup_errors": q_lookup_errors,
    "curve_rate": q_curve_rate,
    "asof_rate": q_asof_rate,
    "asof_index": q_asof_index,
    "asof_fx": q_asof_fx,
    "schedule": q_schedule,
    "ip_schedule": q_ip_schedule,
    "rr_schedule": q_rr_schedule,
    "year_fraction": q_year_fraction,
    "pam_fixed": q_pam_fixed,
    "pam_running": q_pam_running,
    "pam_floating": q_pam_floating,
    "pam_full": q_pam_full,
    "pam_defects": q_pam_defects,
    "nested_defects": q_nested_defects,
    "events_nested": q_events_nested,
    "events_flat": q_events_flat,
    "events_text": q_events_text,
    "events_ids": q_events_ids,
    "events_parquet_roundtrip": q_events_parquet_roundtrip,
    "events_count": q_events_count,
    "cash_by_currency_month": q_cash_by_currency_month,
    "run_text": q_run_text,
    "run_parquet": q_run_parquet,
    "run_short": q_run_short,
    "load_factors": q_load_factors,
    "parse_files": q_parse_files,
    "time_spec_file": q_time_spec_file,
    "parse_filtered": q_parse_filtered,
    "observed_counts": q_observed_counts,
    "sql_functions": q_sql_functions,
}


def oracles() -> dict[str, str]:
    from flowbook.plans import oracle as O
    return O.all_sql()
