"""Contract lines to typed contract terms.

A line is split on ``;`` and each term is read from a fixed position.  Terms
are read in setter order and one bad or missing term leaves it and every later
term unset (the *prefix rule*); the row is kept with ``err_pos`` set, and the
``rejects`` view lists it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbook.functions import parsing as P
from flowbook.functions.daycount import DAY_COUNT_CODES
from flowbook.functions.steps import own_step

# Positions of the terms in a contract line, in setter order.
# (position, column, kind)
FULL_LAYOUT = [
    (4, "status_date", "date"),
    (5, "role", "role"),
    (7, "contract_id", "text"),
    (9, "ip_anchor", "date"),
    (10, "ip_cycle", "cycle"),
    (11, "rate", "double"),
    (12, "dcc", "dcc"),
    (16, "currency", "text"),
    (17, "deal_date", "date"),
    (18, "ied", "date"),
    (19, "md", "date"),
    (20, "notional", "double"),
    (21, "prd", "date"),
    (22, "pprd", "double"),
    (23, "td", "date"),
    (24, "ptd", "double"),
    (25, "sc_moc", "code"),
    (26, "sc_index", "double"),
    (30, "rr_anchor", "date"),
    (31, "rr_cycle", "cycle"),
    (32, "rr_spread", "double"),
    (33, "rr_moc", "code"),
    (34, "rr_point", "point"),
    (35, "rr_fixing", "period"),
    (36, "rr_next", "double"),
    (37, "rr_mult", "double"),
    (38, "rr_term", "period"),
    (39, "pdied", "double"),
]

# The short layout (currency to notional one place to the right).
SHORT_LAYOUT = [
    (4, "status_date", "date"),
    (5, "role", "role"),
    (7, "contract_id", "text"),
    (9, "ip_anchor", "date"),
    (10, "ip_cycle", "cycle"),
    (11, "rate", "double"),
    (12, "dcc", "dcc"),
    (17, "currency", "text"),
    (18, "deal_date", "date"),
    (19, "ied", "date"),
    (20, "md", "date"),
    (21, "notional", "double"),
]

LAYOUTS = {"full": FULL_LAYOUT, "short": SHORT_LAYOUT}

# Contract roles and their sign.
ROLE_SIGN = {"RPA": 1, "RPL": -1}
CYCLE_POINTS = ("B", "E")

# Terms without which a contract has no cash flow: ``NULL``, empty or ``NaN`` rejects.
REQUIRED = ("rate", "ied", "md", "notional")

TERM_TYPES = {
    "date": "date", "role": "string", "text": "string", "cycle": "string",
    "double": "double", "dcc": "string", "code": "string", "point": "string",
    "period": "string",
}

# Every column a valuation needs; the short layout leaves the rest NULL.
ALL_TERMS = [(name, TERM_TYPES[kind]) for _, name, kind in FULL_LAYOUT]


def _term(raw: Column, kind: str, required: bool = False) -> tuple[Column, Column]:
    """(parsed value, term accepted) for one raw token."""
    present = raw.isNotNull()
    if kind == "double":
        v = P.parse_double(raw)
        n = P.nan_to_null(v)
        return n, present & (n if required else v).isNotNull()
    if kind == "date":
        v = P.parse_date(raw)
        if required:
            return v, present & v.isNotNull()
        return v, present & (P.is_null_token(raw) | v.isNotNull())
    if kind == "cycle":
        return P.null_if_token(raw), present & (P.is_null_token(raw) | P.is_cut(P.cycle_parts(raw)))
    if kind == "period":
        return P.null_if_token(raw), present & (P.is_null_token(raw) | P.is_cut(P.period_parts(raw)))
    if kind == "point":
        return P.null_if_token(raw), present & (P.is_null_token(raw) | raw.isin(*CYCLE_POINTS))
    if kind == "role":
        return raw, present & raw.isin(*ROLE_SIGN)
    if kind == "dcc":
        return raw, present & raw.isin(*DAY_COUNT_CODES)
    if kind == "code":
        return P.null_if_token(raw), present
    return raw, present  # text


def parse_contracts(lines: DataFrame, layout: str = "full", value_col: str = "value",
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed contract terms from text lines, with the prefix rule and error columns.

    Output: every column of ``ALL_TERMS`` (NULL where the layout has no such
    term), ``err_pos`` (first bad position in setter order), ``err_field``,
    ``err_token``, plus the columns named in ``keep``.  The result is fenced: what
    is selected or filtered from it never inlines the parser.
    """
    spec = LAYOUTS[layout]
    tokens = P.java_split(F.col(value_col))
    raw = lines.select(*keep, tokens.alias("_tok")).select(
        *keep, "_tok", *[P.token(F.col("_tok"), pos).alias(f"_r{pos}") for pos, _, _ in spec])
    vals, oks = [], []
    for pos, name, kind in spec:
        value, ok = _term(F.col(f"_r{pos}"), kind, name in REQUIRED)
        vals.append((own_step(f"_r{pos}", "string") if name == "contract_id" else value).alias(f"_v{pos}"))
        oks.append(F.when(~ok, F.lit(pos)))
    err_pos = F.least(*oks) if len(oks) > 1 else oks[0]
    staged = raw.select(*keep, "_tok", *vals, err_pos.alias("err_pos"))
    field_of = F.create_map(*[x for pos, name, _ in spec for x in (F.lit(pos), F.lit(name))])
    by_name = {name: pos for pos, name, _ in spec}
    cols = []
    for name, typ in ALL_TERMS:
        if name in by_name:
            pos = by_name[name]
            cols.append(F.when(F.col("err_pos").isNull() | (F.lit(pos) < F.col("err_pos")),
                               F.col(f"_v{pos}")).cast(typ).alias(name))
        else:
            cols.append(F.lit(None).cast(typ).alias(name))
    return fence(staged.select(
        *keep, *cols, F.col("err_pos"),
        F.try_element_at(field_of, F.col("err_pos")).alias("err_field"),
        F.get(F.col("_tok"), F.col("err_pos")).alias("err_token"),
    ))


def fence(df: DataFrame) -> DataFrame:
    """A one-row-in, one-row-out generate that filters are not pushed through.

    Without it the optimizer rewrites a filter on a parsed column in terms of the
    text: the split and all term parsers are inlined into the filter once per
    reference, which multiplies the parse work and overflows generated code.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def clean(contracts: DataFrame) -> DataFrame:
    """Contracts whose every term parsed."""
    return (contracts.filter(F.col("err_pos").isNull())
            .drop("err_pos", "err_field", "err_token"))


def rejects(contracts: DataFrame) -> DataFrame:
    """One row per contract with a bad term: id (if read), position, field, raw token."""
    return contracts.filter(F.col("err_pos").isNotNull()).select(
        "contract_id", "err_pos", "err_field", "err_token")


def rejects_by_field(contracts: DataFrame) -> DataFrame:
    return rejects(contracts).groupBy("err_field").agg(F.count(F.lit(1)).alias("n_rejects"))


def role_sign(role: Column) -> Column:
    """RPA +1, RPL -1."""
    out = None
    for r, s in ROLE_SIGN.items():
        out = F.when(role == r, F.lit(s)) if out is None else out.when(role == r, F.lit(s))
    return out
