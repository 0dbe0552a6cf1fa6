"""Event schedules of principal-at-maturity contracts (E1-E13), as array
expressions on the contract row; one ``explode`` turns them into event rows.

Rules (published contract semantics, or our decision where marked [D]):
  IED at ``ied``; MD at ``md``.
  IP: cycle dates from the interest anchor (``ied`` + one cycle when unset)
      before ``md``, then ``md``.  No cycle: the anchor (if before ``md``) and ``md``.
  RR: cycle dates from the reset anchor before ``md`` (``md`` excluded [D]);
      only those after t0; the first one is RRF when a next reset rate is set.
  Stub: a long stub (``+``/``L0``) drops the last cycle date before the end
      unless the cycle hits the end exactly; a short stub keeps it.
  Fixing: a reset observes at its date (cycle point ``B``) or at the next reset
      date, ``md`` for the last (``E``), minus the fixing period.
  PRD, TD at their dates; events after TD are dropped.
  Order within a date by type rank [D].

Implementation: no array lambdas.  For each contract the number of cycle
dates before an end date has a closed form (months between the two dates,
then one ``add_months`` check in the end month), so the stub rule, the first
reset after t0 and the event count are integer columns.  One ``explode`` over
``0 .. count-1`` then gives each event row its index, and the date, type and
observation date follow from the index with ``add_months`` / ``CASE``: all
code-generated, one generate per contract.  The projections are steps of their own
(``functions.steps``), so the code of each is short enough to be compiled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbook.functions import parsing as P
from flowbook.functions.dates import shift
from flowbook.functions.steps import but, own_step

# Fixed values [D]: event type rank within one date.
EVENT_RANK = {"IED": 10, "IP": 20, "RRF": 30, "RR": 40, "PRD": 50, "TD": 60, "MD": 70}
#: The interest payment at ``md`` among the segments of a contract's events.
_IP_AT_MD = 21
#: The rank as a column that is NULL for a rejected contract: what the type follows from.
KIND = "_kind"


def count_before(start: Column, end: Column, n: Column, unit: Column) -> Column:
    """Number of cycle dates ``start + k*n units`` (k >= 0) strictly before ``end``.

    Month units: dates with ``k*step`` below the month distance fall in an
    earlier month; only ``k*step`` equal to it lands in the end month and needs
    a day check.  Day units: a ceiling division.  0 when anything is NULL.
    """
    months = P.unit_months(unit)
    days = P.unit_days(unit)
    step_m = n * months
    step_d = n * days
    span_m = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    q = F.floor(span_m / step_m).cast("int")
    by_m = F.when(span_m < 0, F.lit(0)).otherwise(
        q + 1 - F.when(F.add_months(start, q * step_m) >= end, F.lit(1)).otherwise(F.lit(0)))
    diff = F.datediff(end, start)
    by_d = F.when(diff <= 0, F.lit(0)).otherwise(F.floor((diff - 1) / step_d).cast("int") + 1)
    out = (F.when((months.isNotNull()) & (step_m > 0), by_m)
           .when((days.isNotNull()) & (step_d > 0), by_d)
           .otherwise(F.when(start < end, F.lit(1)).otherwise(F.lit(0))))
    return F.coalesce(out, F.lit(0))


def count_before_steps(start: Column, end: Column, step_m: Column, step_d: Column) -> Column:
    """``count_before`` from per-contract steps (no text parsing per row)."""
    span_m = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    q = F.floor(span_m / step_m).cast("int")
    by_m = F.when(span_m < 0, F.lit(0)).otherwise(
        q + 1 - F.when(F.add_months(start, q * step_m) >= end, F.lit(1)).otherwise(F.lit(0)))
    diff = F.datediff(end, start)
    by_d = F.when(diff <= 0, F.lit(0)).otherwise(F.floor((diff - 1) / step_d).cast("int") + 1)
    out = (F.when(step_m > 0, by_m).when(step_d > 0, by_d)
           .otherwise(F.when(start < end, F.lit(1)).otherwise(F.lit(0))))
    return F.coalesce(out, F.lit(0))


def cycle_date(start: Column, k: Column, step_m: Column, step_d: Column) -> Column:
    """The ``k``-th cycle date from per-contract steps in months or days; the
    start itself when there is no cycle."""
    return (F.when(step_m.isNotNull(), F.add_months(start, k * step_m))
            .when(step_d.isNotNull(), F.date_add(start, k * step_d))
            .otherwise(start))


def _steps(n: Column, unit: Column, prefix: str) -> list[Column]:
    return [(n * P.unit_months(unit)).alias(f"{prefix}_sm"), (n * P.unit_days(unit)).alias(f"{prefix}_sd")]


def _stub_count(gen: Column, start: Column, end: Column, n: Column, unit: Column,
                long: Column, cycle: Column) -> Column:
    """Drop the last generated date for a long stub unless the cycle hits ``end``."""
    hit = F.coalesce(shift(start, gen, n, unit) == end, F.lit(False))
    drop = cycle.isNotNull() & long & ~hit & (gen > 0)
    return gen - F.when(drop, F.lit(1)).otherwise(F.lit(0))


def with_schedule_counts(contracts: DataFrame, t0: Column) -> DataFrame:
    """Per contract: cycle parts, starts and event counts per segment.

    Segments in index order: IED, IP cycle dates, IP at ``md``, resets after t0,
    PRD, TD, MD.  Each count is already cut at the termination date (E6: keep
    events before TD, and those on its date ranked at most TD), so the
    exploded rows need no filter.
    """
    c = F.col
    parsed = contracts.select("*", P.cycle_parts(c("ip_cycle")).alias("_ip"), P.cycle_parts(c("rr_cycle")).alias("_rr"),
                              P.period_parts(c("rr_fixing")).alias("_fx"))
    s1 = parsed.select(
        *but(contracts.columns, "md"), own_step("md", "date"),
        P.n_of(c("_ip")).alias("_ip_n"), P.unit_of(c("_ip")).alias("_ip_u"), P.is_long(c("_ip")).alias("_ip_long"),
        P.n_of(c("_rr")).alias("_rr_n"), P.unit_of(c("_rr")).alias("_rr_u"), P.is_long(c("_rr")).alias("_rr_long"),
        (c("rr_anchor").isNotNull() | c("rr_cycle").isNotNull()).alias("_has_rr"),
        F.date_add(c("td"), 1).alias("_td_next"),
        P.n_of(c("_fx")).alias("_fx_n"), P.unit_of(c("_fx")).alias("_fx_u"))
    s2 = s1.select(
        *but(s1.columns, "md"), own_step("md", "date"),
        *_steps(c("_ip_n"), c("_ip_u"), "_ip"), *_steps(c("_rr_n"), c("_rr_u"), "_rr"),
        *_steps(c("_fx_n"), c("_fx_u"), "_fx"),
        F.when(c("ip_cycle").isNull(), c("ip_anchor")).otherwise(
            F.coalesce(c("ip_anchor"), shift(c("ied"), F.lit(1), c("_ip_n"), c("_ip_u")))).alias("_ip_start"),
        F.when(c("rr_cycle").isNull(), c("rr_anchor")).otherwise(
            F.coalesce(c("rr_anchor"), shift(c("ied"), F.lit(1), c("_rr_n"), c("_rr_u")))).alias("_rr_start"))
    ip = (c("_ip_start"), c("_ip_n"), c("_ip_u"))
    rr = (c("_rr_start"), c("_rr_n"), c("_rr_u"))
    s3 = s2.select(
        *but(s2.columns, "md"), own_step("md", "date"),
        count_before(ip[0], c("md"), ip[1], ip[2]).alias("_ip_gen"),
        F.when(c("_has_rr"), count_before(rr[0], c("md"), rr[1], rr[2])).otherwise(F.lit(0)).alias("_rr_gen"),
        F.when(c("_has_rr"), count_before(rr[0], F.date_add(t0, 1), rr[1], rr[2]))
        .otherwise(F.lit(0)).alias("_rr_past"),
        count_before(ip[0], c("_td_next"), ip[1], ip[2]).alias("_ip_td"),
        F.when(c("_has_rr"), count_before(rr[0], c("_td_next"), rr[1], rr[2])).otherwise(F.lit(0)).alias("_rr_td"))
    s4 = s3.select(
        *but(s3.columns, "md"), own_step("md", "date"),
        _stub_count(c("_ip_gen"), ip[0], c("md"), ip[1], ip[2], c("_ip_long"), c("ip_cycle")).alias("_n_ip"),
        _stub_count(c("_rr_gen"), rr[0], c("md"), rr[1], rr[2], c("_rr_long"), c("rr_cycle")).alias("_n_rr"))
    no_td = c("td").isNull()
    flag = lambda cond: F.when(cond, F.lit(1)).otherwise(F.lit(0))
    cap = lambda n, at_td: F.when(no_td, n).otherwise(F.least(n, at_td))
    s5 = s4.select(
        *but(s4.columns, "md"), own_step("md", "date"),
        F.least(c("_rr_past"), c("_n_rr")).alias("_k0"),
        flag(no_td | (c("ied") <= c("td"))).alias("_c_ied"),
        cap(c("_n_ip"), c("_ip_td")).alias("_c_ip"),
        flag(no_td | (c("md") <= c("td"))).alias("_c_ipmd"),
        flag(c("prd").isNotNull() & (no_td | (c("prd") <= c("td")))).alias("_c_prd"),
        flag(~no_td).alias("_c_td"),
        flag(no_td | (c("md") < c("td"))).alias("_c_md"))
    s6 = s5.select("*", F.greatest(cap(c("_n_rr"), c("_rr_td")) - c("_k0"), F.lit(0)).alias("_c_rr"))
    return s6.select(
        *but(s6.columns, "md"), own_step("md", "date"),
        c("_c_ied").alias("_o_ip"),
        (c("_c_ied") + c("_c_ip")).alias("_o_ipmd"),
        (c("_c_ied") + c("_c_ip") + c("_c_ipmd")).alias("_o_rr"),
        (c("_c_ied") + c("_c_ip") + c("_c_ipmd") + c("_c_rr")).alias("_o_prd"),
        (c("_c_ied") + c("_c_ip") + c("_c_ipmd") + c("_c_rr") + c("_c_prd")).alias("_o_td"),
        (c("_c_ied") + c("_c_ip") + c("_c_ipmd") + c("_c_rr") + c("_c_prd") + c("_c_td")).alias("_o_md"))


def explode_events(contracts: DataFrame, t0: Column) -> DataFrame:
    """One row per event (``event_date, seq, type, obs_date``, and the rank
    ``_kind`` and accrual group ``_grp`` that the state windows order by).

    One generate over the event index per contract (not a union per type).
    A rejected contract (``err_pos`` set) has no events: it stays as one row
    whose ``type`` and ``event_date`` are NULL, so that its line still gets a
    (empty) nested result; filters on ``reported`` or ``type`` drop it.
    """
    c = F.col
    cols = list(contracts.columns)
    counted = with_schedule_counts(contracts, t0)
    n_events = c("_o_md") + c("_c_md")
    if "err_pos" in cols:
        n_events = F.when(c("err_pos").isNull(), n_events).otherwise(F.lit(0))
    idx = counted.select("*", F.explode_outer(F.when(n_events > 0, F.sequence(F.lit(0), n_events - 1))).alias("_i"))
    i = c("_i")
    seg = (F.when(i.isNull(), F.lit(None)).when(i < c("_o_ip"), F.lit(EVENT_RANK["IED"])).when(i < c("_o_ipmd"), F.lit(EVENT_RANK["IP"]))
           .when(i < c("_o_rr"), F.lit(_IP_AT_MD)).when(i < c("_o_prd"), F.lit(EVENT_RANK["RR"]))
           .when(i < c("_o_td"), F.lit(EVENT_RANK["PRD"])).when(i < c("_o_md"), F.lit(EVENT_RANK["TD"])).otherwise(F.lit(EVENT_RANK["MD"])))
    s1 = idx.select(*cols, own_step("_i", "int"), "_ip_start", "_ip_sm", "_ip_sd", "_rr_start", "_rr_sm", "_rr_sd",
                    "_fx_sm", "_fx_sd", "_n_rr", "_o_ip", "_o_rr", "_c_ip", "_c_ipmd", seg.alias("_seg"),
                    (c("_k0") + (i - c("_o_rr"))).alias("_k_rr"))
    sg, k_rr = c("_seg"), c("_k_rr")
    rr_date = cycle_date(c("_rr_start"), k_rr, c("_rr_sm"), c("_rr_sd"))
    is_rrf = (i == c("_o_rr")) & c("rr_next").isNotNull()
    s2 = s1.select(
        *but(s1.columns, "_i"), own_step("_i", "int"),
        (F.when(sg == EVENT_RANK["IED"], c("ied"))
         .when(sg == EVENT_RANK["IP"], cycle_date(c("_ip_start"), i - c("_o_ip"), c("_ip_sm"), c("_ip_sd")))
         .when(sg == EVENT_RANK["RR"], rr_date)
         .when(sg == EVENT_RANK["PRD"], c("prd"))
         .when(sg == EVENT_RANK["TD"], c("td"))
         .when(sg.isNotNull(), c("md"))).alias("event_date"),
        F.when(sg == _IP_AT_MD, F.lit(EVENT_RANK["IP"]))
        .when((sg == EVENT_RANK["RR"]) & is_rrf, F.lit(EVENT_RANK["RRF"])).otherwise(sg).alias(KIND))
    next_rr = F.when(k_rr + 1 < c("_n_rr"), cycle_date(c("_rr_start"), k_rr + 1, c("_rr_sm"), c("_rr_sd"))) \
        .otherwise(c("md"))
    base = F.when(c("rr_point") == "E", next_rr).otherwise(c("event_date"))
    obs = F.when(sg == EVENT_RANK["RR"], cycle_date(base, F.lit(-1), c("_fx_sm"), c("_fx_sd")))
    # Accrual group (X5): interest payments strictly before this event in
    # (date, rank) order -- IP cycle dates before it, and the IP at ``md``.
    d, q = c("event_date"), c(KIND)
    s3 = s2.select(*cols, "event_date", KIND, obs.alias("obs_date"), "_ip_start", "_ip_sm", "_ip_sd", "_c_ip", "_c_ipmd", "_seg", own_step("_i", "int"), "_o_ip",
                   F.when(q > EVENT_RANK["IP"], F.date_add(d, 1)).otherwise(d).alias("_end"))
    ip_before = F.least(count_before_steps(c("_ip_start"), c("_end"), c("_ip_sm"), c("_ip_sd")), c("_c_ip"))
    md_before = F.when((c("_c_ipmd") == 1) & ((c("md") < d) | ((c("md") == d) & (q > EVENT_RANK["IP"]))),
                       F.lit(1)).otherwise(F.lit(0))
    # Interest events know their group from their index; only IED, resets,
    # PRD and TD need the date count (a CASE evaluates the taken branch only).
    grp = (F.when(sg == EVENT_RANK["IP"], i - c("_o_ip"))
           .when(sg == _IP_AT_MD, c("_c_ip"))
           .when(sg == EVENT_RANK["MD"], c("_c_ip") + c("_c_ipmd"))
           .otherwise(ip_before + md_before))
    return s3.select(*but(cols, "md"), own_step("md", "date"), "event_date", KIND, seq_of(q).alias("seq"), type_of(q).alias("type"), "obs_date", grp.alias("_grp"))


def seq_of(kind: Column) -> Column:
    """The rank of an event from its kind; a rejected contract's row ranks last."""
    return F.coalesce(kind, F.lit(EVENT_RANK["MD"]))


def type_of(kind: Column) -> Column:
    """The type's name; NULL for a rejected contract's row."""
    out = F
    for name, rank in EVENT_RANK.items():
        out = out.when(kind == rank, F.lit(name))
    return out


def schedule_table(contracts: DataFrame, t0: Column) -> DataFrame:
    """IP and RR schedules per contract, with reset observation dates."""
    return explode_events(contracts.select(
        "contract_id", "ied", "md", "ip_anchor", "ip_cycle", "rr_anchor", "rr_cycle", "rr_next",
        "rr_point", "rr_fixing", "prd", "td", *(["err_pos"] if "err_pos" in contracts.columns else [])), t0).filter(F.col("type").isNotNull())
