"""DuckDB SQL that computes every registered query from the driver's tables.

Written independently of the Spark code: the book is derived straight from
``orders`` with typed columns (no text round trip), schedules with
``generate_series`` and windows, series lookups with ``ASOF JOIN``.  Doubles
are compared after ``floor(x*1e4+0.5)/1e4`` in both engines.
"""

from __future__ import annotations

T0 = "DATE '1998-01-01'"
EARLY_T0 = "DATE '1900-01-01'"


def r4(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5) / 10000.0"


def book_cte(rr: bool = True, prd_td: bool = True, defects: bool = False, premium: bool = True) -> str:
    """Typed clean book (FIXTURES.md section 3); terms switched off are NULL."""
    d0 = "CAST(o_orderdate AS DATE)"
    k = "o_orderkey"
    rr_cols = (f"""
      CASE WHEN {k} % 2 = 1 THEN CAST({d0} + to_months(6) AS DATE) END AS rr_anchor,
      CASE WHEN {k} % 2 = 1 THEN '6M-' END AS rr_cycle,
      CASE WHEN {k} % 101 = 0 THEN 'MISSING' WHEN {k} % 103 = 0 THEN 'BAD_1'
           WHEN {k} % 107 = 0 THEN 'ODD_1' WHEN {k} % 6 = 1 THEN 'RATE_A'
           WHEN {k} % 6 = 3 THEN 'RATE_N' WHEN {k} % 6 = 5 THEN 'CURVE_1' END AS rr_moc"""
               if rr else """
      CAST(NULL AS DATE) AS rr_anchor, CAST(NULL AS VARCHAR) AS rr_cycle,
      CAST(NULL AS VARCHAR) AS rr_moc""")
    pt_cols = (f"""
      CASE WHEN {k} % 11 = 0 THEN CAST({d0} + 45 AS DATE) END AS prd,
      CASE WHEN {k} % 11 = 0 THEN o_totalprice END AS pprd,
      CASE WHEN {k} % 13 = 0 THEN CAST({d0} + 200 AS DATE) END AS td,
      CASE WHEN {k} % 13 = 0 THEN o_totalprice END AS ptd"""
               if prd_td else """
      CAST(NULL AS DATE) AS prd, CAST(NULL AS DOUBLE) AS pprd,
      CAST(NULL AS DATE) AS td, CAST(NULL AS DOUBLE) AS ptd""")
    return f"""
  pri AS (
    SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 3
                WHEN '3-MEDIUM' THEN 6 WHEN '4-NOT SPECIFIED' THEN 7 WHEN '5-LOW' THEN 5 END AS ip_m,
              CASE o_orderpriority WHEN '1-URGENT' THEN '1M-' WHEN '2-HIGH' THEN '1Q-'
                WHEN '3-MEDIUM' THEN '1H-' WHEN '4-NOT SPECIFIED' THEN '7M-' WHEN '5-LOW' THEN '5M+' END AS ip_cycle
    FROM orders),
  book AS (
    SELECT
      'C' || {k} AS contract_id, {k} AS k,
      DATE '1998-01-01' AS status_date,
      CASE WHEN o_orderstatus = 'P' THEN 'RPL' ELSE 'RPA' END AS role,
      CASE WHEN o_orderstatus = 'P' THEN CAST(-1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS sgn,
      CASE WHEN {k} % 4 = 0 THEN NULL ELSE CAST({d0} + to_months(ip_m) AS DATE) END AS ip_anchor,
      ip_cycle, ip_m, ip_cycle = '5M+' AS ip_long,
      CAST(10 + ({k} % 9) * 5 AS DOUBLE) / CAST(1000 AS DOUBLE) AS rate,
      CASE {k} % 4 WHEN 0 THEN 'A/360' WHEN 1 THEN 'A/365' WHEN 2 THEN '30E/360' ELSE 'A/AISDA' END AS dcc,
      CASE o_custkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'CHF' ELSE 'JPY' END AS currency,
      CAST({d0} - CAST({k} % 3 AS INTEGER) AS DATE) AS deal_date,
      {d0} AS ied,
      CAST({d0} + to_months(CAST(12 * (1 + {k} % 5) AS INTEGER)) AS DATE) AS md,
      o_totalprice AS notional,{pt_cols},
      CASE WHEN {k} % 70 = 0 THEN 'UNEVEN_1' WHEN {k} % 30 = 0 THEN 'ODD_1' WHEN {k} % 10 = 0 THEN 'IDX_1' END AS sc_moc,
      CAST(100 AS DOUBLE) AS sc_index,{rr_cols},
      CAST({k} % 3 AS DOUBLE) / CAST(1000 AS DOUBLE) AS rr_spread,
      CASE WHEN {k} % 4 = 1 THEN 'E' ELSE 'B' END AS rr_point,
      '2D' AS rr_fixing,
      CASE WHEN {k} % 7 = 0 THEN CAST('0.03' AS DOUBLE) END AS rr_next,
      CAST(1 AS DOUBLE) AS rr_mult,
      '6M' AS rr_term,
      {f'CAST(-10 * ({k} % 5) AS DOUBLE)' if premium else 'CAST(0 AS DOUBLE)'} AS pdied
    FROM pri)"""


FACTOR_CTES = """
  rate_pts AS (
    SELECT 'RATE_' || l_returnflag AS code, 'ReferenceRate' AS rf_type,
           CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS d,
           CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) * 100 AS DOUBLE) AS v
    FROM lineitem GROUP BY 1, 2, 3),
  yearly AS (
    SELECT unnest(range(0, 8)) AS i),
  fixed_pts AS (
    SELECT 'IDX_1' AS code, 'ReferenceIndex' AS rf_type, make_date(1995 + CAST(i AS INTEGER), 1, 1) AS d,
           [100.0, 102, 104, 107, 109, 111, 115, 118][i + 1] AS v FROM yearly
    UNION ALL
    SELECT 'FX_EUR', 'ForeignExchangeRate', make_date(1995 + CAST(i AS INTEGER), 1, 1),
           [1.25, 1.26, 1.13, 1.1, 1.17, 1, 0.94, 0.89][i + 1] FROM yearly
    UNION ALL
    SELECT 'FX_CHF', 'ForeignExchangeRate', make_date(1995 + CAST(i AS INTEGER), 1, 1),
           [0.76, 0.86, 0.74, 0.69, 0.73, 0.63, 0.62, 0.6][i + 1] FROM yearly
    UNION ALL
    SELECT 'FX_JPY', 'ForeignExchangeRate', make_date(1995 + CAST(i AS INTEGER), 1, 1),
           [0.01, 0.0097, 0.0086, 0.0077, 0.0088, 0.0098, 0.0088, 0.0076][i + 1] FROM yearly),
  points AS (
    SELECT code, rf_type, d, 0 AS place, CAST(v AS DOUBLE) AS v FROM rate_pts
    UNION ALL SELECT code, rf_type, d, 0, CAST(v AS DOUBLE) FROM fixed_pts
    UNION ALL SELECT 'IDX_1', 'ReferenceIndex', DATE '1999-01-01', 1, CAST(108 AS DOUBLE)
    UNION ALL SELECT 'ODD_1', 'SomethingElse', DATE '1995-01-01', 0, CAST(1 AS DOUBLE)),
  series AS (
    SELECT code, rf_type, d, v FROM points
    QUALIFY row_number() OVER (PARTITION BY code, d ORDER BY place DESC) = 1),
  curve AS (
    SELECT 'CURVE_1' AS code, CAST(t AS DOUBLE) AS t, CAST(v AS DOUBLE) AS v FROM (VALUES
      (CAST(1 AS DOUBLE) * 1.0 / 12.0, 0.01), (CAST(3 AS DOUBLE) * 1.0 / 12.0, 0.012),
      (CAST(6 AS DOUBLE) * 1.0 / 12.0, 0.015), (CAST(1 AS DOUBLE) * 12.0 / 12.0, 0.02),
      (CAST(2 AS DOUBLE) * 12.0 / 12.0, 0.024), (CAST(5 AS DOUBLE) * 12.0 / 12.0, 0.03),
      (CAST(10 AS DOUBLE) * 12.0 / 12.0, 0.035)) AS c(t, v)),
  curve_half AS (SELECT {curve_half} AS v),
  fmeta AS (
    SELECT code, any_value(rf_type) AS rf_type, true AS reset_ok, true AS scaling_ok FROM series GROUP BY code
    UNION ALL SELECT 'CURVE_1', 'TermStructure', true, false
    UNION ALL SELECT 'BAD_1', 'ReferenceRate', false, false
    UNION ALL SELECT 'UNEVEN_1', 'ReferenceIndex', true, false)"""


def curve_at(term: str) -> str:
    """Linear interpolation on ``curve`` at ``term`` years (correlated subqueries)."""
    lo_t = f"(SELECT max(t) FROM curve c WHERE c.t <= {term})"
    hi_t = f"(SELECT min(t) FROM curve c WHERE c.t >= {term})"
    lo_v = f"(SELECT v FROM curve c WHERE c.t = {lo_t})"
    hi_v = f"(SELECT v FROM curve c WHERE c.t = {hi_t})"
    return f"""(CASE WHEN {lo_t} IS NULL THEN {hi_v} WHEN {hi_t} IS NULL THEN {lo_v}
      WHEN {hi_t} = {lo_t} THEN {lo_v}
      ELSE {lo_v} + ({hi_v} - {lo_v}) * (({term} - {lo_t}) / ({hi_t} - {lo_t})) END)"""


FACTOR_CTES = FACTOR_CTES.replace("{curve_half}", curve_at("CAST(0.5 AS DOUBLE)"))
CURVE_HALF = "(SELECT v FROM curve_half)"


def yf(d1: str, d2: str, dcc: str) -> str:
    days = f"CAST(({d2}) - ({d1}) AS DOUBLE)"

    def ylen(y):
        return f"CAST(make_date(({y}) + 1, 1, 1) - make_date({y}, 1, 1) AS DOUBLE)"
    y1, y2 = f"year({d1})", f"year({d2})"
    e30 = (f"CAST((({y2}) - ({y1})) * 360 + (month({d2}) - month({d1})) * 30 "
           f"+ (least(day({d2}), 30) - least(day({d1}), 30)) AS DOUBLE) / 360.0")
    head = f"CAST(make_date(({y1}) + 1, 1, 1) - ({d1}) AS DOUBLE) / {ylen(y1)}"
    tail = f"CAST(({d2}) - make_date({y2}, 1, 1) AS DOUBLE) / {ylen(y2)}"
    aisda = (f"CASE WHEN {y1} = {y2} THEN {days} / {ylen(y1)} "
             f"ELSE {head} + CAST(({y2}) - ({y1}) - 1 AS DOUBLE) + {tail} END")
    return (f"(CASE WHEN {dcc} = 'A/360' THEN {days} / 360.0 WHEN {dcc} = 'A/365' THEN {days} / 365.0 "
            f"WHEN {dcc} = '30E/360' THEN {e30} WHEN {dcc} = 'A/AISDA' THEN {aisda} END)")


def events_ctes(t0: str, factors: bool = True) -> str:
    """All events with state; needs ``book`` (and the factor CTEs when ``factors``)."""
    span = "((year(md) - year({s})) * 12 + month(md) - month({s}))"
    ip_span = span.format(s="ip_start")
    rr_span = span.format(s="rr_anchor")
    if factors:
        lookup = """
  bk AS (
    SELECT b.*, m.rf_type AS rr_type, m.code IS NOT NULL AS rr_found,
           (b.sc_moc IS NOT NULL AND (b.rr_moc IS NULL OR coalesce(m.reset_ok, false))
            AND b.sc_moc IN (SELECT code FROM fmeta)) AS sc_found
    FROM book b LEFT JOIN fmeta m ON m.code = b.rr_moc),"""
        asof = """
  rr_obs AS (
    SELECT e.contract_id, e.d, s.v AS series_v
    FROM rr_ev e ASOF LEFT JOIN series s ON s.code = e.rr_moc AND e.obs >= s.d),"""
        obs = f"""CASE WHEN e.rr_type = 'TermStructure' THEN {CURVE_HALF}
                       WHEN e.type = 'RR' AND e.rr_type = 'ReferenceRate' THEN o.series_v END"""
        obs_join = "LEFT JOIN rr_obs o ON o.contract_id = e.contract_id AND o.d = e.event_date AND e.type IN ('RR', 'RRF')"
    else:
        lookup = """
  bk AS (SELECT b.*, CAST(NULL AS VARCHAR) AS rr_type, false AS rr_found, false AS sc_found FROM book b),"""
        asof = ""
        obs = "CAST(NULL AS DOUBLE)"
        obs_join = ""
    return f"""
  b1 AS (SELECT *, CAST(ied + to_months(ip_m) AS DATE) AS ip_start FROM book),
  ip_gen AS (
    SELECT contract_id, md, ip_start, ip_m, ip_long, j,
           CAST(ip_start + to_months(CAST(j * ip_m AS INTEGER)) AS DATE) AS d
    FROM (SELECT *, unnest(generate_series(0, greatest({ip_span} // ip_m + 1, 0))) AS j FROM b1)),
  ip_in AS (
    SELECT *, count(*) OVER (PARTITION BY contract_id) AS cnt FROM ip_gen WHERE d < md),
  ip_dates AS (
    SELECT contract_id, d FROM ip_in
    WHERE NOT (ip_long AND cnt > 0 AND j = cnt - 1
               AND CAST(ip_start + to_months(CAST(cnt * ip_m AS INTEGER)) AS DATE) <> md)
    UNION ALL SELECT contract_id, md FROM book),
  rr_gen AS (
    SELECT contract_id, md, rr_point, rr_next, j,
           CAST(rr_anchor + to_months(CAST(j * 6 AS INTEGER)) AS DATE) AS d
    FROM (SELECT *, unnest(generate_series(0, greatest({rr_span} // 6 + 1, 0))) AS j
          FROM book WHERE rr_cycle IS NOT NULL)),
  rr_in AS (
    SELECT *, coalesce(lead(d) OVER (PARTITION BY contract_id ORDER BY d), md) AS nxt
    FROM rr_gen WHERE d < md),
  rr_fut AS (
    SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY d) AS rn
    FROM rr_in WHERE d > {t0}),
  rr_ev0 AS (
    SELECT contract_id, d,
           CASE WHEN rn = 1 AND rr_next IS NOT NULL THEN 'RRF' ELSE 'RR' END AS type,
           CAST((CASE WHEN rr_point = 'E' THEN nxt ELSE d END) - 2 AS DATE) AS obs
    FROM rr_fut),{lookup}
  ev0 AS (
    SELECT contract_id, ied AS event_date, 10 AS seq, 'IED' AS type, CAST(NULL AS DATE) AS obs FROM book
    UNION ALL SELECT contract_id, d, 20, 'IP', NULL FROM ip_dates
    UNION ALL SELECT contract_id, d, CASE WHEN type = 'RRF' THEN 30 ELSE 40 END, type, obs FROM rr_ev0
    UNION ALL SELECT contract_id, prd, 50, 'PRD', NULL FROM book WHERE prd IS NOT NULL
    UNION ALL SELECT contract_id, td, 60, 'TD', NULL FROM book WHERE td IS NOT NULL
    UNION ALL SELECT contract_id, md, 70, 'MD', NULL FROM book),
  ev1 AS (
    SELECT e.*, b.* EXCLUDE (contract_id)
    FROM ev0 e JOIN bk b USING (contract_id)
    WHERE b.td IS NULL OR e.event_date < b.td OR (e.event_date = b.td AND e.seq <= 60)),
  rr_ev AS (SELECT contract_id, event_date AS d, obs, rr_moc FROM ev1 WHERE type = 'RR'),
{asof}
  ev2 AS (
    SELECT e.*, {obs} AS obs_value
    FROM ev1 e {obs_join}),
  s1 AS (
    SELECT *,
      CASE WHEN type = 'IED' THEN rate WHEN type = 'RRF' THEN rr_next
           WHEN type = 'RR' THEN obs_value * coalesce(rr_mult, 1.0) + coalesce(rr_spread, 0.0) END AS rate_set,
      CASE WHEN type = 'IED' THEN sgn * notional WHEN type IN ('MD', 'TD') THEN 0.0 END AS nt_set,
      type IN ('IP', 'MD', 'TD') AS is_reset
    FROM ev2),
  s2 AS (
    SELECT *,
      last_value(rate_set IGNORE NULLS) OVER w_before AS rate_before,
      coalesce(last_value(nt_set IGNORE NULLS) OVER w_before, 0.0) AS nt_before,
      lag(event_date) OVER w AS prev_d,
      coalesce(sum(CASE WHEN is_reset THEN 1 ELSE 0 END) OVER w_before, 0) AS grp
    FROM s1
    WINDOW w AS (PARTITION BY contract_id ORDER BY event_date, seq),
           w_before AS (PARTITION BY contract_id ORDER BY event_date, seq
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  s3 AS (
    SELECT *, coalesce(nt_before * rate_before * {yf('prev_d', 'event_date', 'dcc')}, 0.0) AS inc FROM s2),
  s4 AS (
    SELECT *, sum(inc) OVER (PARTITION BY contract_id, grp ORDER BY event_date, seq
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS acc
    FROM s3),
  events AS (
    SELECT contract_id, event_date, seq, type, currency, rr_moc, sc_moc, sc_found, obs, obs_value,
      CASE WHEN type = 'IED' THEN -sgn * (notional + coalesce(pdied, 0.0))
           WHEN type = 'IP' THEN acc
           WHEN type = 'MD' THEN nt_before + acc
           WHEN type = 'PRD' THEN -(sgn * coalesce(pprd, 0.0) + acc)
           WHEN type = 'TD' THEN sgn * coalesce(ptd, 0.0) + acc
           ELSE 0.0 END AS value,
      coalesce(nt_set, nt_before) AS nominal,
      CASE WHEN is_reset THEN 0.0 ELSE acc END AS accrued,
      event_date > {t0} AND (prd IS NULL OR event_date > prd OR (event_date = prd AND seq >= 50)) AS reported
    FROM s4)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(p.strip().rstrip(",") for p in parts if p.strip())


def present_events(where: str = "reported") -> str:
    return f"""
SELECT contract_id, CAST(event_date AS VARCHAR) AS event_date, seq, type, currency,
       {r4('value')} AS value, {r4('nominal')} AS nominal, {r4('accrued')} AS accrued
FROM events WHERE {where}"""


def pam_sql(t0: str = T0, rr: bool = True, prd_td: bool = True) -> str:
    return with_ctes(book_cte(rr=rr, prd_td=prd_td), FACTOR_CTES if rr else "",
                     events_ctes(t0, factors=rr)) + present_events()


# The term columns of the two layouts with their positions.
FULL_COLUMNS = [
    (4, "status_date"), (5, "role"), (7, "contract_id"), (9, "ip_anchor"), (10, "ip_cycle"),
    (11, "rate"), (12, "dcc"), (16, "currency"), (17, "deal_date"), (18, "ied"), (19, "md"),
    (20, "notional"), (21, "prd"), (22, "pprd"), (23, "td"), (24, "ptd"), (25, "sc_moc"),
    (26, "sc_index"), (30, "rr_anchor"), (31, "rr_cycle"), (32, "rr_spread"), (33, "rr_moc"),
    (34, "rr_point"), (35, "rr_fixing"), (36, "rr_next"), (37, "rr_mult"), (38, "rr_term"),
    (39, "pdied"),
]
SHORT_COLUMNS = FULL_COLUMNS[:12]
DATE_COLUMNS = {"status_date", "ip_anchor", "deal_date", "ied", "md", "prd", "td", "rr_anchor"}
CYCLE_RE = r"^P?(\d+)([DWMQHY])(L?[-+01]?)$"
PERIOD_RE = r"^P?(\d+)([DWMQHY])$"


def _col(name: str) -> str:
    return f"CAST({name} AS VARCHAR)" if name in DATE_COLUMNS else name


def _terms_sql(columns, err: str = "CAST(NULL AS INTEGER)") -> str:
    sel = ",\n  ".join(
        f"CASE WHEN err_pos IS NULL OR {pos} < err_pos THEN {_col(n)} END AS {n}" for pos, n in columns)
    return f"""
SELECT {sel}, err_pos
FROM (SELECT *, {err} AS err_pos FROM book)"""


DEFECT_ERR = ("CASE WHEN k > 0 AND k % 997 = 0 THEN 11 WHEN k > 0 AND k % 971 = 0 THEN 19 "
              "WHEN k > 0 AND (k % 991 = 0 OR k % 977 = 0) THEN 20 END")

TIME_SPEC_CTES = """
  lines AS (
    SELECT CAST(-1 AS BIGINT) AS line_no, '1998-01-01T00;fixture' AS value
    UNION ALL
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN ';;'
           ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%dT%H') || ';' || o_orderpriority || ';' || o_orderstatus END
    FROM orders),
  toks AS (SELECT line_no, CASE WHEN regexp_matches(value, '^;+$') THEN CAST([] AS VARCHAR[])
                ELSE string_split(regexp_replace(value, ';+$', ''), ';') END AS t FROM lines),
  tokens AS (
    SELECT line_no, CAST(unnest(range(len(t))) AS INTEGER) AS pos, unnest(t) AS token FROM toks)"""

CF_CTE = f"""
  cf AS (
    SELECT b.contract_id, b.rr_moc, m.code IS NOT NULL AS rr_found, m.rf_type AS rr_type, b.sc_moc,
           coalesce(m.reset_ok, false) AS rr_ok,
           (b.sc_moc IS NOT NULL AND (b.rr_moc IS NULL OR coalesce(m.reset_ok, false)) AND ms.code IS NOT NULL) AS sc_found,
           (b.sc_moc IS NOT NULL AND (b.rr_moc IS NULL OR coalesce(m.reset_ok, false)) AND coalesce(ms.scaling_ok, false)) AS sc_ok,
           CASE WHEN m.rf_type = 'TermStructure' THEN {CURVE_HALF} END AS rr_curve_rate
    FROM book b LEFT JOIN fmeta m ON m.code = b.rr_moc LEFT JOIN fmeta ms ON ms.code = b.sc_moc)"""


def _full(body: str, t0: str = T0) -> str:
    return with_ctes(book_cte(), FACTOR_CTES, events_ctes(t0)) + body


def _dates(body: str) -> str:
    """Event dates (``ev1``) need neither factors nor state."""
    return with_ctes(book_cte(), events_ctes(T0, factors=False)) + body


def _nested_body() -> str:
    def lst(expr, typ):
        return (f"coalesce(list({expr} ORDER BY event_date, seq) FILTER (WHERE reported), "
                f"CAST([] AS {typ}[]))")
    return f"""
  nested AS (
    SELECT contract_id,
      {lst('contract_id', 'VARCHAR')} AS id,
      {lst("CAST(event_date AS VARCHAR) || 'T00:00Z'", 'VARCHAR')} AS date,
      {lst('type', 'VARCHAR')} AS type,
      {lst('currency', 'VARCHAR')} AS currency,
      {lst(r4('value'), 'DOUBLE')} AS value,
      {lst(r4('nominal'), 'DOUBLE')} AS nominal,
      {lst(r4('accrued'), 'DOUBLE')} AS accrued
    FROM events GROUP BY contract_id)"""


FLAT_BODY = f"""
SELECT CAST(row_number() OVER (PARTITION BY contract_id ORDER BY event_date, seq) - 1 AS INTEGER) AS idx,
       contract_id AS id, CAST(event_date AS VARCHAR) || 'T00:00Z' AS date, type, currency,
       {r4('value')} AS value, {r4('nominal')} AS nominal, {r4('accrued')} AS accrued
FROM events WHERE reported"""


def all_sql() -> dict[str, str]:
    book_only = with_ctes(book_cte())
    book_defects = with_ctes(book_cte())
    factors_only = with_ctes(book_cte(), FACTOR_CTES)

    def arr(name):
        return f"'[' || array_to_string({name}, ',') || ']'"

    def num_arr(name):
        return f"'[' || array_to_string(list_transform({name}, lambda x: printf('%.4f', x)), ',') || ']'"

    rejected = f"({DEFECT_ERR} IS NOT NULL)"
    out = {
        "pam_defects": pam_sql() + f" AND contract_id NOT IN (SELECT contract_id FROM book WHERE {rejected})",
        "nested_defects": _full(f"""
SELECT CAST(count(e.contract_id) AS INTEGER) AS n_events, {r4('min(e.value)')} AS least, {r4('max(e.value)')} AS most
FROM (SELECT contract_id, {rejected} AS bad, unnest([1, 2]) AS copy FROM book) b
LEFT JOIN (SELECT * FROM events WHERE reported) e ON e.contract_id = b.contract_id AND NOT b.bad
GROUP BY b.contract_id, b.copy"""),
        "parse_full": book_only + _terms_sql(FULL_COLUMNS),
        "parse_short": book_only + _terms_sql(SHORT_COLUMNS),
        "parse_prefix": book_defects + _terms_sql(FULL_COLUMNS, DEFECT_ERR),
        "parse_rejects": book_only + f"""
SELECT 'C' || k AS contract_id, err_pos, CASE err_pos WHEN 11 THEN 'rate' WHEN 19 THEN 'md' ELSE 'notional' END AS err_field,
       CASE WHEN err_pos = 11 THEN 'abc' WHEN err_pos = 19 THEN 'NULL' WHEN k % 991 <> 0 THEN 'NaN' END AS err_token
FROM (SELECT k, {DEFECT_ERR} AS err_pos FROM book) WHERE err_pos IS NOT NULL""",
        "parse_reject_counts": book_only + f"""
SELECT CASE err_pos WHEN 11 THEN 'rate' WHEN 19 THEN 'md' ELSE 'notional' END AS err_field, count(*) AS n_rejects
FROM (SELECT k, {DEFECT_ERR} AS err_pos FROM book) WHERE err_pos IS NOT NULL GROUP BY 1""",
        "cycles": book_only + f"""
SELECT contract_id,
  CAST(regexp_extract(ip_cycle, '{CYCLE_RE}', 1) AS INTEGER) AS ip_n,
  regexp_extract(ip_cycle, '{CYCLE_RE}', 2) AS ip_unit,
  regexp_extract(ip_cycle, '{CYCLE_RE}', 3) AS ip_stub,
  coalesce(regexp_extract(ip_cycle, '{CYCLE_RE}', 3) IN ('+', 'L0'), false) AS ip_long,
  CAST(regexp_extract(rr_cycle, '{CYCLE_RE}', 1) AS INTEGER) AS rr_n,
  regexp_extract(rr_cycle, '{CYCLE_RE}', 2) AS rr_unit,
  regexp_extract(rr_cycle, '{CYCLE_RE}', 3) AS rr_stub,
  coalesce(regexp_extract(rr_cycle, '{CYCLE_RE}', 3) IN ('+', 'L0'), false) AS rr_long,
  CAST(regexp_extract(rr_fixing, '{PERIOD_RE}', 1) AS INTEGER) AS fixing_n,
  regexp_extract(rr_fixing, '{PERIOD_RE}', 2) AS fixing_unit,
  CAST(regexp_extract(rr_term, '{PERIOD_RE}', 1) AS DOUBLE) * 1.0 / 12.0 AS term_years
FROM book""",
        "t0_tokens": with_ctes(TIME_SPEC_CTES) + "\nSELECT line_no, pos, token FROM tokens",
        "analysis_date": with_ctes(TIME_SPEC_CTES) + """
SELECT CAST(CAST(substr(arg_min(token, line_no * 100000 + pos), 1, 10) AS DATE) AS VARCHAR) AS t0
FROM tokens WHERE trim(token) <> ''""",
        "factor_points": factors_only + """
SELECT code, rf_type, CAST(row_number() OVER (PARTITION BY code ORDER BY d, place) - 1 AS INTEGER) AS pos,
       CAST(d AS VARCHAR) AS obs_date, CAST(NULL AS DOUBLE) AS tenor_years, v AS value FROM points
WHERE rf_type <> 'SomethingElse'
UNION ALL
SELECT code, 'TermStructure', CAST(row_number() OVER (PARTITION BY code ORDER BY t) - 1 AS INTEGER),
       NULL, t, v FROM curve""",
        "factor_rejects": """
SELECT code, rf_type, CAST(line_no AS BIGINT) AS line_no, reason FROM (VALUES
  ('BAD_1', 'ReferenceRate', 1006, 'value'), ('UNEVEN_1', 'ReferenceIndex', 1007, 'length')) AS v(code, rf_type, line_no, reason)""",
        "factor_dedup": """
SELECT 'RATE_' || l_returnflag AS code, CAST(1 + ascii(l_returnflag) AS BIGINT) AS line_no,
       'ReferenceRate' AS rf_type,
       CAST(count(DISTINCT date_trunc('month', CAST(l_shipdate AS DATE))) AS INTEGER) AS n_keys
FROM lineitem GROUP BY l_returnflag
UNION ALL
SELECT code, CAST(line_no AS BIGINT), rf_type, CAST(n_keys AS INTEGER) FROM (VALUES
  ('CURVE_1', 1000, 'TermStructure', 7), ('IDX_1', 1001, 'ReferenceIndex', 9),
  ('FX_EUR', 1002, 'ForeignExchangeRate', 8), ('FX_CHF', 1003, 'ForeignExchangeRate', 8),
  ('FX_JPY', 1004, 'ForeignExchangeRate', 8), ('ODD_1', 1005, 'SomethingElse', 1),
  ('BAD_1', 1006, 'ReferenceRate', 3), ('UNEVEN_1', 1007, 'ReferenceIndex', 2))
  AS v(code, line_no, rf_type, n_keys)""",
        "contract_factors": with_ctes(book_cte(), FACTOR_CTES, CF_CTE) + f"""
SELECT contract_id, rr_moc, rr_found, rr_ok, rr_type, sc_moc, sc_found, sc_ok, {r4('rr_curve_rate')} AS rr_curve_rate FROM cf""",
        "lookup_errors": with_ctes(book_cte(), FACTOR_CTES, CF_CTE) + """
SELECT contract_id, rr_moc AS code, 'reset' AS usage, CASE WHEN rr_found THEN 'unreadable' ELSE 'missing' END AS status
FROM cf WHERE rr_moc IS NOT NULL AND NOT rr_ok
UNION ALL
SELECT contract_id, sc_moc, 'scaling',
       CASE WHEN rr_moc IS NOT NULL AND NOT rr_ok THEN 'skipped' WHEN sc_found THEN 'unreadable' ELSE 'missing' END
FROM cf WHERE sc_moc IS NOT NULL AND NOT sc_ok""",
        "curve_rate": factors_only + f"""
SELECT contract_id, {r4('tt')} AS term_years, {r4(curve_at('tt'))} AS curve_rate
FROM (SELECT b.contract_id, CAST(b.md - {T0} AS DOUBLE) / 365.0 AS tt
      FROM book b JOIN fmeta m ON m.code = b.rr_moc WHERE m.rf_type = 'TermStructure')""",
        "asof_rate": _full("""
SELECT contract_id, CAST(event_date AS VARCHAR) AS event_date, CAST(obs AS VARCHAR) AS obs_date,
       rr_moc AS code, obs_value
FROM ev2 WHERE type = 'RR'"""),
        "asof_index": _full("""
SELECT e.contract_id, CAST(e.event_date AS VARCHAR) AS event_date, e.seq, e.type, s.v AS index_value
FROM (SELECT * FROM events WHERE reported AND sc_found) e
ASOF LEFT JOIN series s ON s.code = e.sc_moc AND e.event_date >= s.d"""),
        "asof_fx": _full(f"""
SELECT e.contract_id, CAST(e.event_date AS VARCHAR) AS event_date, e.seq, e.type, e.currency,
       CASE WHEN e.currency = 'USD' THEN 1.0 ELSE s.v END AS fx_rate,
       {r4("e.value * (CASE WHEN e.currency = 'USD' THEN 1.0 ELSE s.v END)")} AS value_usd
FROM (SELECT *, 'FX_' || currency AS fx_code FROM events WHERE reported) e
ASOF LEFT JOIN series s ON s.code = e.fx_code AND e.event_date >= s.d"""),
        "schedule": _dates("""
SELECT contract_id, CAST(event_date AS VARCHAR) AS event_date, seq, type, CAST(obs AS VARCHAR) AS obs_date
FROM ev1"""),
        "ip_schedule": _dates("""
SELECT contract_id, CAST(event_date AS VARCHAR) AS event_date FROM ev1 WHERE type = 'IP'"""),
        "rr_schedule": _dates("""
SELECT contract_id, CAST(event_date AS VARCHAR) AS event_date, type, CAST(obs AS VARCHAR) AS obs_date
FROM ev1 WHERE type IN ('RR', 'RRF')"""),
        "year_fraction": book_only + f"""
SELECT contract_id, dcc, {yf('ied', 'md', 'dcc')} AS yf,
       {yf('ied', 'md', "'A/360'")} AS yf_a360, {yf('ied', 'md', "'A/365'")} AS yf_a365,
       {yf('ied', 'md', "'30E/360'")} AS yf_30e360, {yf('ied', 'md', "'A/AISDA'")} AS yf_aisda
FROM book""",
        "pam_fixed": pam_sql(EARLY_T0, rr=False, prd_td=False),
        "pam_running": pam_sql(T0, rr=False, prd_td=False),
        "pam_floating": pam_sql(T0, rr=True, prd_td=False),
        "pam_full": pam_sql(T0),
        "events_nested": with_ctes(book_cte(), FACTOR_CTES, events_ctes(T0), _nested_body()) + """
SELECT id, date, type, currency, value, nominal, accrued FROM nested""",
        "events_flat": _full(FLAT_BODY),
        "events_text": with_ctes(book_cte(), FACTOR_CTES, events_ctes(T0), _nested_body()) + f"""
SELECT concat_ws(';', {arr('id')}, {arr('date')}, {arr('type')}, {arr('currency')},
                 {num_arr('value')}, {num_arr('nominal')}, {num_arr('accrued')}) AS line
FROM nested""",
        "events_ids": with_ctes(book_cte(), FACTOR_CTES, events_ctes(T0), _nested_body()) + """
SELECT array_to_string(id, ',') AS line FROM nested""",
        "events_parquet_roundtrip": _full(FLAT_BODY),
        "events_count": "SELECT count(*) AS n FROM orders",
        "cash_by_currency_month": with_ctes(book_cte(), FACTOR_CTES, events_ctes(T0),
                                            "flat AS (" + FLAT_BODY + ")") + """
SELECT currency, substr(date, 1, 7) AS month, count(*) AS n_events,
       floor(sum(value) * 10000 + 0.5) / 10000.0 AS total_value,
       floor(sum(CASE WHEN type = 'IP' THEN value ELSE 0.0 END) * 10000 + 0.5) / 10000.0 AS interest
FROM flat GROUP BY currency, substr(date, 1, 7)""",
        "run_text": _full(FLAT_BODY),
        "run_parquet": _full(FLAT_BODY),
        "run_short": with_ctes(book_cte(rr=False, prd_td=False, premium=False), events_ctes("DATE '1993-06-01'", factors=False)) + FLAT_BODY,
        "load_factors": factors_only + """
SELECT code, rf_type, CAST(first_d AS VARCHAR) AS first_date, CAST(last_d AS VARCHAR) AS last_date, last_value,
       n_tenors, reset_ok, scaling_ok
FROM fmeta LEFT JOIN (SELECT code, min(d) AS first_d, max(d) AS last_d, arg_max(v, d) AS last_value FROM series GROUP BY code) s USING (code)
LEFT JOIN (SELECT code, CAST(count(*) AS INTEGER) AS n_tenors FROM curve GROUP BY code) c USING (code)""",
        "parse_files": book_defects + _terms_sql(FULL_COLUMNS, DEFECT_ERR),
        "time_spec_file": with_ctes(TIME_SPEC_CTES) + """
SELECT CAST(CAST(substr(arg_min(token, line_no * 100000 + pos), 1, 10) AS DATE) AS VARCHAR) AS t0
FROM tokens WHERE trim(token) <> ''""",
        "parse_filtered": f"""
SELECT * FROM ({book_defects + _terms_sql(FULL_COLUMNS, DEFECT_ERR)})
WHERE dcc = 'A/360' AND (rr_moc = 'RATE_A' OR err_pos IS NOT NULL)""",
        "observed_counts": with_ctes(book_cte(), FACTOR_CTES, CF_CTE) + f""",
  bad AS (SELECT contract_id, {DEFECT_ERR} AS err_pos FROM book)
SELECT 'reject:' || CASE err_pos WHEN 11 THEN 'rate' WHEN 19 THEN 'md' ELSE 'notional' END AS metric, count(*) AS n
FROM bad WHERE err_pos IS NOT NULL GROUP BY 1
UNION ALL
SELECT 'reset:' || CASE WHEN rr_found THEN 'unreadable' ELSE 'missing' END, count(*)
FROM cf JOIN bad USING (contract_id) WHERE err_pos IS NULL AND rr_moc IS NOT NULL AND NOT rr_ok GROUP BY 1
UNION ALL
SELECT 'scaling:' || CASE WHEN rr_moc IS NOT NULL AND NOT rr_ok THEN 'skipped' WHEN sc_found THEN 'unreadable' ELSE 'missing' END, count(*)
FROM cf JOIN bad USING (contract_id) WHERE err_pos IS NULL AND sc_moc IS NOT NULL AND NOT sc_ok GROUP BY 1""",
        "sql_functions": book_only + f"""
SELECT contract_id, {yf('ied', 'md', 'dcc')} AS yf, {yf('ied', 'md', "'A/AISDA'")} AS yf_aisda,
       CAST(CAST(ied + to_months(CAST(2 * ip_m AS INTEGER)) AS DATE) AS VARCHAR) AS second_date, CAST(sgn AS INTEGER) AS sign
FROM book""",
    }
    return out
