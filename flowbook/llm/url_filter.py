"""URL filters by a temporal list join (op3), in DataFrame functions only.

A block list has dated entries: at ``listed_at`` an action adds or removes a key
(a host, a parent domain, or a host with a first path segment) in a category.
Consecutive entries of one (category, key) become validity intervals
``[valid_from, valid_to)``.  A capture has a fetch time and a few keys (its host,
the host's parent domains, host/segment); an as-of join over (key, month) finds
the entries that were active when it was fetched.  The list's months are broadcast
within the bounds of ``broadcast``; beyond them the join is a shuffle in which the
frequent (key, month) pairs of the captures are measured and salted, so a host that
holds most captures of a month is spread over many tasks.

Null or odd urls have no key and match nothing.  Repeated entries count once; of
entries of one key at one time, a removal wins.  An entry without a time, key or
action is left out.  Rows of ``pages`` are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowbook.llm.store import stored
from flowbook.operators import skew
from flowbook.operators.broadcast import bounded

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
SEGMENT = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]+)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def keys_of(url: Column) -> Column:
    """The host, each parent domain of two labels or more, and host/first segment."""
    parts = F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, i, 100), "."))
    segment = F.regexp_extract(F.coalesce(url, F.lit("")), SEGMENT, 1)
    path = F.when(segment != "", F.array(F.concat(host_of(url), F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, path)))


def month(t: Column) -> Column:
    return F.year(t) * 12 + F.month(t)


def intervals(entries: DataFrame) -> DataFrame:
    """(category, key, valid_from, valid_to) from (category, key, listed_at, action); ``valid_to`` null: still valid."""
    own = entries.filter("key IS NOT NULL AND listed_at IS NOT NULL AND action IN ('add', 'remove')")
    once = own.groupBy("category", "key", "listed_at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("category", "key").orderBy("listed_at")
    changes = once.withColumn("was", F.lag("action").over(w)).filter("was IS NULL OR was != action")
    spans = changes.withColumn("valid_to", F.lead("listed_at").over(w))
    return spans.filter("action = 'add'").select("category", "key", F.col("listed_at").alias("valid_from"), "valid_to")


def active(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with ``categories``: the sorted categories active at fetch time (empty: not blocked)."""
    rows = captures.withColumn("flowbook_row", F.monotonically_increasing_id())
    asked = rows.select("flowbook_row", F.col(time_col).alias("at"), F.explode(keys_of(F.col(url_col))).alias("key")).withColumn("m", month(F.col("at")))
    horizon = captures.agg(F.max(month(F.col(time_col)))).first()[0] or 0  # one value; no interval need go beyond
    begin = month(F.col("valid_from"))
    end = F.least(F.coalesce(month(F.col("valid_to")), F.lit(horizon)), F.lit(horizon))
    months = intervals(entries).filter(begin <= horizon).withColumn("m", F.explode(F.sequence(begin, F.greatest(begin, end))))
    small, fits = bounded(stored(months.select("category", "key", "valid_from", "valid_to", "m"), "list-months"))
    hits = ((asked.join(small, ["key", "m"]) if fits else _salted(asked, small))
            .filter((F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
            .groupBy("flowbook_row").agg(F.array_sort(F.collect_set("category")).alias("found")))
    return rows.join(hits, "flowbook_row", "left").select(
        *[rows[f"`{c}`"] for c in captures.columns], F.coalesce("found", F.array().cast("array<string>")).alias("categories"))


def _salted(asked: DataFrame, months: DataFrame) -> DataFrame:
    """The join on (key, m) with as many salts for a pair as its share of the captures asks for."""
    pair = F.concat_ws(" ", "key", F.col("m").cast("string"))
    asked = asked.filter("m IS NOT NULL").withColumn("pair", pair)
    hot = skew.measure(asked, pair=F.col("pair"))["pair"]
    drawn = asked.withColumn(skew.SALT, hot.draw(F.col("pair"), F.col("flowbook_row")))
    return drawn.join(hot.repeated(months.withColumn("pair", pair), "pair").drop("pair"), ["key", "m", skew.SALT])
