"""Contract state through time (X2-X10) with window functions over the events
of each contract, ordered by (date, type rank).

  rate:     set by IED (contract rate), RRF (next reset rate),
            RR (observed * multiplier + spread; missing observation: unchanged [D]).
  notional: set by IED (sign * notional), MD and TD (0).
  accrual:  notional before * rate before * year fraction since the previous
            event; accrued interest is reset by IP, MD and TD.
  value:    IED -sign*(N + premium); IP accrued; MD notional before + accrued;
            PRD -(sign*price + accrued); TD sign*price + accrued; RR/RRF 0.
  reported: events after t0 and not before the purchase (X9, X10, E9).

All windows are per input line (``contract_key``) and share its partitioning
(no exchange); the
accrued-interest group sum needs a second sort within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowbook.functions.daycount import DAY_COUNT_CODES, year_fraction
from flowbook.functions.steps import but
from flowbook.operators.contracts import role_sign
from flowbook.operators.schedule import EVENT_RANK, KIND, seq_of, type_of


LINE_KEY = "line_key"


def contract_key(df: DataFrame) -> list[str]:
    """What tells contracts apart: the line they came from, where it is known.
    Two lines with one id are two contracts, and ids that failed to parse are
    no common key.  The line comes first: a sort by a number that rises in the input
    is cheap, one by ids compares texts."""
    return [LINE_KEY, "contract_id"] if LINE_KEY in df.columns else ["contract_id"]


def with_amounts(contracts: DataFrame) -> DataFrame:
    """What the events of a contract share, once a contract: signed amounts of IED, PRD
    and TD, the signed notional and the day count as a number."""
    sign = role_sign(F.col("role")).cast("double")
    paid = lambda c: sign * F.coalesce(F.col(c), F.lit(0.0))
    dcc = F
    for i, code in enumerate(DAY_COUNT_CODES):
        dcc = dcc.when(F.col("dcc") == code, F.lit(i))
    return contracts.select(
        "*", (-sign * (F.col("notional") + F.coalesce(F.col("pdied"), F.lit(0.0)))).alias("_a_ied"),
        (-paid("pprd")).alias("_a_prd"), paid("ptd").alias("_a_td"), (sign * F.col("notional")).alias("_nt"), dcc.alias("_dcc"))


def roll_state(events: DataFrame, t0: Column, obs_col: str = "obs_value") -> DataFrame:
    """Adds ``value, nominal, accrued, reported``; needs the event columns,
    ``rate, rr_next, rr_mult, rr_spread, prd`` and those of ``with_amounts``.

    The windows hold what they need and no more: the type follows from the rank."""
    kind = F.col(KIND)
    key = contract_key(events)
    r = EVENT_RANK
    # ``_grp`` (interest payments before the event, from the schedule) never
    # falls in (date, rank) order, so ordering by (group, date, rank) is the
    # same order, and the accrual window below reuses this sort.
    if "_grp" not in events.columns:
        g = Window.partitionBy(*key).orderBy("event_date", KIND).rowsBetween(
            Window.unboundedPreceding, -1)
        events = events.select("*", F.coalesce(
            F.sum(kind.isin(r["IP"], r["MD"], r["TD"]).cast("int")).over(g), F.lit(0)).alias("_grp"))
    w = Window.partitionBy(*key).orderBy("_grp", "event_date", KIND)
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    rate_set = (F.when(kind == r["IED"], F.col("rate"))
                .when(kind == r["RRF"], F.col("rr_next"))
                .when(kind == r["RR"], F.col(obs_col) * F.coalesce(F.col("rr_mult"), F.lit(1.0))
                      + F.coalesce(F.col("rr_spread"), F.lit(0.0))))
    nt_set = (F.when(kind == r["IED"], F.col("_nt"))
              .when(kind.isin(r["MD"], r["TD"]), F.lit(0.0)))
    amount = F.when(kind == r["IED"], F.col("_a_ied")).when(kind == r["PRD"], F.col("_a_prd")).when(kind == r["TD"], F.col("_a_td"))
    prd = F.col("prd")
    reported = (F.col("event_date") > t0) & (
        prd.isNull() | (F.col("event_date") > prd)
        | ((F.col("event_date") == prd) & (seq_of(kind) >= r["PRD"])))

    s1 = events.select(
        *but(events.columns, "seq", "type"),
        rate_set.alias("_rate_set"), nt_set.alias("_nt_set"), amount.alias("_amount"), reported.alias("reported"))
    s2 = s1.select(
        "*",
        F.last("_rate_set", ignorenulls=True).over(before).alias("_rate_before"),
        F.coalesce(F.last("_nt_set", ignorenulls=True).over(before), F.lit(0.0)).alias("_nt_before"),
        F.lag("event_date").over(w).alias("_prev_d"))
    inc = F.coalesce(F.col("_nt_before") * F.col("_rate_before")
                     * year_fraction(F.col("_prev_d"), F.col("event_date"), F.col("_dcc"), range(len(DAY_COUNT_CODES))), F.lit(0.0))
    s3 = s2.select("*", inc.alias("_inc"))
    # Accrued interest: sum of the accruals since the last reset.  A running
    # sum minus its value at the reset would save a sort but cancels digits
    # (money must round the same way); the group sum is exact per group.
    w_grp = (Window.partitionBy(*key, "_grp").orderBy("event_date", KIND)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s4 = s3.select("*", F.sum("_inc").over(w_grp).alias("_acc"))
    acc, nt_before = F.col("_acc"), F.col("_nt_before")
    value = (F.when(kind == r["IED"], F.col("_amount"))
             .when(kind == r["IP"], acc)
             .when(kind == r["MD"], nt_before + acc)
             .when(kind == r["PRD"], F.col("_amount") - acc)
             .when(kind == r["TD"], F.col("_amount") + acc)
             .otherwise(F.lit(0.0)))
    out = s4.select(
        "*", seq_of(kind).alias("seq"), type_of(kind).alias("type"),
        value.alias("value"),
        F.coalesce(F.col("_nt_set"), nt_before).alias("nominal"),
        F.when(kind.isin(r["IP"], r["MD"], r["TD"]), F.lit(0.0)).otherwise(acc).alias("accrued"))
    work = {KIND, "_grp", "_rate_set", "_nt_set", "_amount", "_rate_before", "_nt_before", "_prev_d", "_inc", "_acc"}
    return out.select(*[c for c in out.columns if c not in work])
