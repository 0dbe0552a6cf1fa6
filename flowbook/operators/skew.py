"""Hot join keys, measured, and salts for those only.

Beyond the broadcast bound a lookup is a shuffle join on a factor code, and one
code may serve most of a book.  ``measure`` takes the frequent keys of a table in
one aggregation with a frequent-items sketch (``approx_top_k``, bounded in size,
merged across tasks), and gives each as many salts as its share of the rows asks
for: ``PER_PARTITION`` for every partition's worth of rows.  The probing side draws
one of its key's salts, the other side is repeated once per salt of its key, and
every key that is not hot keeps one.  At most ``TRACKED`` keys come to the driver;
a key beyond them has less than one row in ``TRACKED``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are told, and that the sketch of a task keeps.
TRACKED, SKETCHED = 256, 10_000
#: Salts for each partition's worth of rows: enough that hashing spreads them evenly.
PER_PARTITION = 8
SALT = "_m_salt"


@dataclass(frozen=True)
class HotKeys:
    rows: int
    partitions: int
    counts: tuple[tuple[str, int], ...] = ()

    @property
    def salts(self) -> dict[str, int]:
        """Keys with more than one salt."""
        share = max(1.0, self.rows / (self.partitions * PER_PARTITION))
        return {k: n for k, c in self.counts if (n := math.ceil(c / share)) > 1}

    def _of(self, key: Column) -> Column:
        salts = self.salts
        if not salts:
            return F.lit(1)
        table = F.create_map(*[x for k, n in salts.items() for x in (F.lit(k), F.lit(n))])
        return F.when(key.isin(*salts), F.coalesce(F.try_element_at(table, key), F.lit(1))).otherwise(F.lit(1))

    def draw(self, key: Column, spread: Column) -> Column:
        """A salt of ``key`` that follows from ``spread``."""
        return F.pmod(F.xxhash64(spread), self._of(key)).cast("int")

    def repeated(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` once per salt of its key."""
        return df.select("*", F.explode(F.sequence(F.lit(0), self._of(F.col(key)) - 1)).alias(SALT))


def measure(df: DataFrame, **keys: Column) -> dict[str, HotKeys]:
    """The frequent values of each key column; one pass over ``df``."""
    names = list(keys)
    text = df.select(*[c.cast("string").alias(k) for k, c in keys.items()])
    row = text.agg(F.count(F.lit(1)).alias("_n"), *[F.expr(f"approx_top_k({k}, {TRACKED}, {SKETCHED})").alias(k) for k in names]).first()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return {k: HotKeys(row["_n"], parts, tuple((x["item"], x["count"]) for x in row[k] or [] if x["item"] is not None)) for k in names}
