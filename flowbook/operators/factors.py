"""Risk factors: dedup (J1), typed points (J6, P6-P8, F4), per-contract lookups
(J2, J3, J5, F1-F3, F5), curve rate (J8) and as-of series lookups (J7, J9, J10).

Factor lines look like ``code;<ignored>;type;k1!k2!..;v1!v2!..``.  The keys are
dates for the series types and periods (tenors) for ``TermStructure``.

As-of design: each series is cut into intervals ``[d_i, d_{i+1})`` inside its
own row (no window, no shuffle), and each interval is listed once per calendar
month it touches.  A lookup joins on ``(code, month)`` plus the range test, so a
probe scans only the few intervals of one month, and a hot code spreads over
many join keys.  Dates at or after the last observation take the last value
from the per-code metadata row, so no interval is open-ended.  Curves are cut the
same way, into segments between tenors, and read by one range join on the code.
Where the factor side is too large to broadcast, hot codes are measured and
salted (``operators.skew``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbook.functions import parsing as P
from flowbook.functions.dates import month_index
from flowbook.operators import broadcast as B
from flowbook.operators import skew
from flowbook.operators.state import LINE_KEY

# Risk-factor types.
TERM_STRUCTURE = "TermStructure"
REFERENCE_RATE = "ReferenceRate"
REFERENCE_INDEX = "ReferenceIndex"
FX_RATE = "ForeignExchangeRate"
KNOWN_TYPES = (TERM_STRUCTURE, REFERENCE_RATE, REFERENCE_INDEX, FX_RATE)
DATED_TYPES = (REFERENCE_RATE, REFERENCE_INDEX, FX_RATE)

def factor_records(lines: DataFrame) -> DataFrame:
    """``(line_no, code, rf_type, keys ARRAY<STRING>, vals ARRAY<STRING>)``."""
    tok = P.java_split(F.col("value"))
    return lines.select(
        "line_no",
        P.token(tok, 0).alias("code"),
        P.token(tok, 2).alias("rf_type"),
        P.java_split(P.token(tok, 3), P.ARRAY_SEP).alias("keys"),
        P.java_split(P.token(tok, 4), P.ARRAY_SEP).alias("vals"))


def dedup(records: DataFrame) -> DataFrame:
    """One record per code, the last line wins (``max_by`` on ``line_no``,
    partially aggregated per task)."""
    last = F.max_by(F.struct("line_no", "rf_type", "keys", "vals"), "line_no")
    return (records.groupBy("code").agg(last.alias("r"))
            .select("code", "r.line_no", "r.rf_type", "r.keys", "r.vals"))


def series(lines: DataFrame) -> DataFrame:
    """Typed, sorted points per code, one row per code, of every type.

    ``pts ARRAY<STRUCT<d DATE, pos INT, v DOUBLE>>`` where the keys are dates,
    ``curve ARRAY<STRUCT<t DOUBLE, pos INT, v DOUBLE>>`` (tenor in years) for
    curves.  A line is read as a whole: if one key or value does not parse, or
    there are not as many keys as values, the array is NULL and the line is in
    ``factor_rejects``.  Of points with equal keys the later one is last.
    """
    rec = dedup(factor_records(lines))
    is_curve = F.col("rf_type") == TERM_STRUCTURE

    def points(name, parse):
        p = F.transform(F.arrays_zip("keys", "vals"), lambda x, i: F.struct(
            parse(x["keys"]).alias(name), i.alias("pos"), P.nan_to_null(P.parse_double(x["vals"])).alias("v")))
        whole = F.size("keys") == F.size("vals")
        return F.when(whole & F.forall(p, lambda x: x[name].isNotNull() & x["v"].isNotNull()), F.array_sort(p))

    return rec.select(
        "code", "rf_type", "line_no", F.size("keys").alias("n_keys"), F.size("vals").alias("n_vals"),
        F.when(~F.coalesce(is_curve, F.lit(False)), points("d", P.parse_date)).alias("pts"),
        F.when(is_curve, points("t", P.period_years)).alias("curve"))


def factor_rejects(lines: DataFrame) -> DataFrame:
    """The lines in use that do not read as what their type says (an unknown
    type: as a dated series), with the reason: ``length`` or ``value``."""
    bad = series(lines).filter("pts IS NULL AND curve IS NULL")
    reason = F.when(F.col("n_keys").isNull() | (F.col("n_keys") != F.col("n_vals")) | (F.col("n_vals").isNull()), "length")
    return bad.select("code", "rf_type", "line_no", reason.otherwise("value").alias("reason"))


def factor_points(lines: DataFrame) -> DataFrame:
    """Every point of every known factor as a row:
    ``code, rf_type, pos, obs_date, tenor_years, value``."""
    s = series(lines).filter(F.col("rf_type").isin(*KNOWN_TYPES))
    dated = s.filter(F.col("pts").isNotNull()).select(
        "code", "rf_type", F.posexplode("pts").alias("pos", "p")).select(
        "code", "rf_type", "pos", F.col("p.d").alias("obs_date"),
        F.lit(None).cast("double").alias("tenor_years"), F.col("p.v").alias("value"))
    curves = s.filter(F.col("curve").isNotNull()).select(
        "code", "rf_type", F.posexplode("curve").alias("pos", "p")).select(
        "code", "rf_type", "pos", F.lit(None).cast("date").alias("obs_date"),
        F.col("p.t").alias("tenor_years"), F.col("p.v").alias("value"))
    return dated.unionByName(curves)


def meta(series_df: DataFrame) -> DataFrame:
    """One row per code: type, first and last observation, last value, curve, and
    whether the line reads as a reset factor (F3: types other than the two are
    ignored there, without an error) and as an index (F5: whatever its type)."""
    pts = F.col("pts")
    read = (F.when(F.col("rf_type") == TERM_STRUCTURE, F.col("curve").isNotNull())
            .when(F.col("rf_type") == REFERENCE_RATE, pts.isNotNull()).otherwise(F.lit(True)))
    return series_df.select(
        "code", "rf_type",
        F.try_element_at(pts, F.lit(1))["d"].alias("first_date"),
        F.try_element_at(pts, F.lit(-1))["d"].alias("last_date"),
        F.try_element_at(pts, F.lit(-1))["v"].alias("last_value"),
        "curve", read.alias("reset_ok"), pts.isNotNull().alias("scaling_ok"))


def _neighbours(series_df: DataFrame, points: str) -> DataFrame:
    """``code``, ``here`` and ``after``: each point and the next one (NULL after the last)."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    pairs = series_df.filter(F.size(points) > 0).select("code", F.col(points).alias("here"), F.slice(points, F.lit(2), n).alias("after"))
    return pairs.select("code", F.explode(F.arrays_zip("here", "after")).alias("p")).select("code", "p.here", "p.after")


def intervals(series_df: DataFrame) -> DataFrame:
    """Bounded as-of intervals ``[d_from, d_to)`` listed per month they touch:
    ``code, bucket, d_from, d_to, value``."""
    rows = _neighbours(series_df, "pts").select("code", F.col("here.d").alias("d_from"), F.col("after.d").alias("d_to"), F.col("here.v").alias("value"))
    rows = rows.filter(F.col("d_to") > F.col("d_from"))
    buckets = F.sequence(month_index(F.col("d_from")), month_index(F.date_sub("d_to", 1)))
    return rows.select("code", F.explode(buckets).alias("bucket"), "d_from", "d_to", "value")


def segments(series_df: DataFrame) -> DataFrame:
    """A curve as segments ``[t_from, t_to)`` that cover every term: ``code, t_from,
    t_to, t, width, value, rise``; the rate is ``value + rise * ((term - t) / width)``,
    linear between tenors and flat outside.  Of equal tenors the last one holds at it."""
    flat = [F.lit(0.0).alias("t"), F.lit(1.0).alias("width")]
    ends = [F.lit(float(x)) for x in ("-inf", "inf")]
    before = series_df.filter(F.size("curve") > 0).select(
        "code", ends[0].alias("t_from"), F.col("curve")[0]["t"].alias("t_to"), *flat, F.col("curve")[0]["v"].alias("value"), F.lit(0.0).alias("rise"))
    near = _neighbours(series_df, "curve")
    last = F.col("after").isNull()
    from_here = near.filter(last | (F.col("after.t") > F.col("here.t"))).select(
        "code", F.col("here.t").alias("t_from"), F.coalesce("after.t", ends[1]).alias("t_to"), F.when(last, 0.0).otherwise(F.col("here.t")).alias("t"),
        F.when(last, 1.0).otherwise(F.col("after.t") - F.col("here.t")).alias("width"), F.col("here.v").alias("value"),
        F.when(last, 0.0).otherwise(F.col("after.v") - F.col("here.v")).alias("rise"))
    return before.unionByName(from_here)


class FactorTables:
    """The per-code metadata and the as-of intervals of one factor file, each
    hinted for broadcast when its size check passes."""

    def __init__(self, lines: DataFrame):
        # The typed series (one row per code) is written to the shared folder:
        # the size checks and the joins read the factor text once, and a lost
        # executor re-reads the files, not the lineage.
        from flowbook.plans.sinks import materialise
        self.series = materialise(series(lines), "factors")
        self.meta, self.meta_broadcast = B.bounded(meta(self.series))
        self.intervals, self.intervals_broadcast = B.bounded(intervals(self.series))
        self.segments, self.segments_broadcast = B.bounded(segments(self.series))

    @property
    def broadcast(self) -> bool:
        return self.meta_broadcast and self.intervals_broadcast and self.segments_broadcast


def _spread_of(df: DataFrame, other: Column | None = None) -> Column:
    """What tells contracts apart, never NULL: the line, whatever its id."""
    key = F.col(LINE_KEY) if LINE_KEY in df.columns else other if other is not None else F.col("contract_id")
    return F.coalesce(key.cast("string"), F.lit(""))


def _apart(key: Column, spread: Column) -> Column:
    """``key``, or where it is NULL one that no factor has and that spreads over the shuffle."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), spread))


def join_meta(df: DataFrame, factors: FactorTables, m: DataFrame, key: Column, code: str, hot: skew.HotKeys | None = None) -> DataFrame:
    """Left join of ``df`` to metadata ``m`` on ``key`` = ``code``.

    In the shuffle path a hot code's rows are dealt to several keys (its metadata is
    repeated as often; ``hot`` is measured on ``df`` where it isn't given), and rows
    without a key get one that no factor has.
    """
    if factors.meta_broadcast:
        return df.join(m, key == F.col(code), "left")
    hot, spread = hot or skew.measure(df, key=key)["key"], _spread_of(df)
    cond = (_apart(key, spread) == F.col(code)) & (hot.draw(key, spread) == F.col(skew.SALT))
    return df.join(hot.repeated(m, code), cond, "left").drop(skew.SALT)


def lookup_code(contracts: DataFrame, factors: FactorTables, code_col: str, prefix: str,
                gate: Column | None = None, ok: str = "reset_ok", hot: skew.HotKeys | None = None) -> DataFrame:
    """Left join of each contract to the metadata of ``code_col``.

    Adds ``{prefix}_found`` (there is a line), ``_ok`` (and it reads for this use,
    the metadata's ``ok``), ``_type``, ``_first``, ``_last``, ``_last_value``.  With ``gate`` false the lookup is skipped (J5: a failed reset
    lookup skips the scaling lookup).
    """
    m = factors.meta.select(
        F.col("code").alias(f"{prefix}_code"),
        F.col("rf_type").alias(f"{prefix}_type"),
        F.col("first_date").alias(f"{prefix}_first"),
        F.col("last_date").alias(f"{prefix}_last"),
        F.col("last_value").alias(f"{prefix}_last_value"),
        F.col(ok).alias(f"{prefix}_ok"))
    key = F.col(code_col) if gate is None else F.when(gate, F.col(code_col))
    joined = join_meta(contracts, factors, m, key, f"{prefix}_code", hot)
    rest = [c for c in joined.columns if c not in (f"{prefix}_code", f"{prefix}_ok")]
    return joined.select(*rest, F.col(f"{prefix}_code").isNotNull().alias(f"{prefix}_found"),
                         F.coalesce(f"{prefix}_ok", F.lit(False)).alias(f"{prefix}_ok"))


def curve_rate(curve: Column, term_years: Column) -> Column:
    """J8 on one row's curve array: linear between tenors, flat outside.  For a table
    of contracts ``with_curve_rate`` joins the segments instead."""
    lo = F.try_element_at(F.filter(curve, lambda p: p["t"] <= term_years), F.lit(-1))
    hi = F.try_element_at(F.filter(curve, lambda p: p["t"] >= term_years), F.lit(1))
    return (F.when(lo.isNull(), hi["v"])
            .when(hi.isNull(), lo["v"])
            .when(hi["t"] == lo["t"], lo["v"])
            .otherwise(lo["v"] + (hi["v"] - lo["v"]) * ((term_years - lo["t"]) / (hi["t"] - lo["t"]))))


def with_curve_rate(df: DataFrame, factors: FactorTables, code: Column, term_years: Column, out: str,
                    hot: skew.HotKeys | None = None) -> DataFrame:
    """``out`` = the rate of curve ``code`` at ``term_years``; NULL without a curve or term."""
    seg = factors.segments.select(*[F.col(c).alias(f"_s_{c}") for c in ("code", "t_from", "t_to", "t", "width", "value", "rise")])
    staged = df.select("*", F.when(term_years.isNotNull(), code).alias("_s_key"), term_years.alias("_s_term"))
    inside = (F.col("_s_term") >= F.col("_s_t_from")) & (F.col("_s_term") < F.col("_s_t_to"))
    if factors.segments_broadcast:
        joined = staged.join(seg, (F.col("_s_key") == F.col("_s_code")) & inside, "left")
    else:
        hot, spread = hot or skew.measure(staged, key=F.col("_s_key"))["key"], _spread_of(df)
        cond = (_apart(F.col("_s_key"), spread) == F.col("_s_code")) & (hot.draw(F.col("_s_key"), spread) == F.col(skew.SALT)) & inside
        joined = staged.join(hot.repeated(seg, "_s_code"), cond, "left")
    rate = F.col("_s_value") + F.col("_s_rise") * ((F.col("_s_term") - F.col("_s_t")) / F.col("_s_width"))
    return joined.select(*df.columns, rate.alias(out))


def asof_value(df: DataFrame, factors: FactorTables, code: Column, at: Column,
               first: Column, last: Column, last_value: Column, out: str,
               spread_key: Column | None = None, hot: skew.HotKeys | None = None) -> DataFrame:
    """``out`` = value of the series ``code`` at date ``at`` (last
    observation at or before it; NULL before the first or for an unknown code).

    Rows inside ``[first, last)`` probe the month intervals; later ones take
    ``last_value``.  Without a broadcast, rows that do not probe get a key no
    interval has (by their line, else ``spread_key``), so they spread over the
    shuffle instead of piling up on the NULL key, and hot codes are salted (``hot``
    is measured on ``df`` where it isn't given).
    """
    probe = at.isNotNull() & (at >= first) & (at < last)
    iv = factors.intervals.select(
        F.col("code").alias("_iv_code"), F.col("bucket").alias("_iv_bucket"),
        F.col("d_from").alias("_iv_from"), F.col("d_to").alias("_iv_to"),
        F.col("value").alias("_iv_value"))
    key, salt = F.when(probe, code), F.lit(0)
    if not factors.intervals_broadcast:
        hot, spread = hot or skew.measure(df, key=key)["key"], _spread_of(df, spread_key)
        iv, key, salt = hot.repeated(iv, "_iv_code"), _apart(key, spread), hot.draw(key, spread)
    staged = df.select("*", key.alias("_k_code"), at.alias("_k_at"), salt.alias("_k_salt"))
    cond = ((F.col("_k_code") == F.col("_iv_code"))
            & (month_index(F.col("_k_at")) == F.col("_iv_bucket"))
            & (F.col("_k_at") >= F.col("_iv_from")) & (F.col("_k_at") < F.col("_iv_to")))
    if not factors.intervals_broadcast:
        cond = cond & (F.col("_k_salt") == F.col(skew.SALT))
    joined = staged.join(iv, cond, "left")
    value = F.when(at >= last, last_value).when(probe, F.col("_iv_value"))
    return joined.select(*df.columns, value.alias(out))


def lookup_errors(contracts: DataFrame) -> DataFrame:
    """Codes a contract names but the factor file does not have, or whose line
    does not read.

    Output ``contract_id, code, usage ('reset'|'scaling'), status
    ('missing'|'unreadable'|'skipped')``; a scaling lookup is skipped when the
    reset lookup failed, as in the reference.
    """
    rr_bad = F.col("rr_moc").isNotNull() & ~F.col("rr_ok")
    sc_bad = F.col("sc_moc").isNotNull() & (rr_bad | ~F.col("sc_ok"))

    def why(p):
        return F.when(~F.col(f"{p}_found"), F.lit("missing")).otherwise(F.lit("unreadable"))

    def err(code, usage, status):
        return F.struct(code.alias("code"), F.lit(usage).alias("usage"), status.alias("status"))

    errs = F.array(
        F.when(rr_bad, err(F.col("rr_moc"), "reset", why("rr"))),
        F.when(sc_bad, err(F.col("sc_moc"), "scaling",
                           F.when(rr_bad, F.lit("skipped")).otherwise(why("sc")))))
    return (contracts.select("contract_id", F.explode(F.filter(errs, lambda e: e.isNotNull())).alias("e"))
            .select("contract_id", "e.code", "e.usage", "e.status"))
