"""Moments that are kept and updated: count, mean and sum of squared deviations per key.

An increment is a change feed: new rows, and the old versions of rows they replace. Both are
reduced to moments per key (map-side combined), merged with the stored moments of the keys they
touch, and committed as a delta of a :class:`~tempora.streaming.snapshot.Snapshot`. Neither the
rows behind the stored moments nor the moments of other keys are computed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.streaming.snapshot import Snapshot

COLUMNS = ("n", "mean", "m2")


def moments(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, m2) of the values that are not missing."""
    x = F.col(value)
    return rows.filter(x.isNotNull()).groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"))


def std(n: Column | str = "n", m2: Column | str = "m2") -> Column:
    """Sample deviation; NULL for fewer than two values."""
    n, m2 = (F.col(c) if isinstance(c, str) else c for c in (n, m2))
    return F.when(n > 1, F.sqrt(F.greatest(m2, F.lit(0.0)) / (n - 1)))


def _side(name: str) -> tuple[Column, Column, Column]:
    zero = lambda c: F.coalesce(F.col(f"{name}.{c}"), F.lit(0.0))
    return zero("n"), zero("mean"), zero("m2")


def merged(kept: DataFrame, added: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of the touched keys after ``added`` joins and ``removed`` leaves the values behind ``kept``.

    ``n`` is 0 where a key has lost all its values.
    """
    parts = [d.select(*keys, F.struct(F.lit(i).alias("part"), *COLUMNS).alias("s")) for i, d in enumerate((kept, added, removed))]
    touched = parts[1].select(*keys).unionByName(parts[2].select(*keys)).distinct()
    rows = parts[0].join(touched, keys, "left_semi").unionByName(parts[1]).unionByName(parts[2])
    # at most three rows a key meet; a grouping, not joins, so a key may be new or gone
    own = lambda i, name: F.max(F.when(F.col("s.part") == i, F.col("s"))).alias(name)
    met = rows.groupBy(*keys).agg(own(0, "a"), own(1, "b"), own(2, "c"))
    (an, am, a2), (bn, bm, b2), (cn, cm, c2) = _side("a"), _side("b"), _side("c")
    n1 = an + bn
    d1 = bm - am
    some = lambda x: F.when(x > 0, x)
    met = met.select(*keys, n1.alias("n1"), (am + F.coalesce(d1 * bn / some(n1), F.lit(0.0))).alias("m1"),
                     (a2 + b2 + F.coalesce(d1 * d1 * an * bn / some(n1), F.lit(0.0))).alias("s1"), cn.alias("cn"), cm.alias("cm"), c2.alias("c2"))
    n = F.col("n1") - F.col("cn")
    met = met.withColumn("n", n).withColumn("mean", F.when(F.col("cn") == 0, F.col("m1")).when(n > 0, (F.col("n1") * F.col("m1") - F.col("cn") * F.col("cm")) / some(n)))
    gone = F.coalesce((F.col("cm") - F.col("mean")) ** 2 * F.col("n") * F.col("cn") / some(F.col("n1")), F.lit(0.0))
    return met.select(*keys, F.col("n").cast("long").alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"),
                      F.when(F.col("n") > 1, F.greatest(F.col("s1") - F.col("c2") - gone, F.lit(0.0))).otherwise(0.0).alias("m2"))


class StoredMoments:
    """Moments of one measure in a folder; ``keys`` must hold a date column ``time`` by whose year the moments are kept."""

    def __init__(self, spark, folder: str, keys: list[str], time: str, value: str):
        self.keys, self.value = list(keys), value
        self.snapshot = Snapshot(spark, folder, keys, time)

    def read(self) -> DataFrame:
        return self.snapshot.read().filter("n > 0")

    def update(self, added: DataFrame, removed: DataFrame | None, batch: int) -> int:
        """Commit an increment; ``removed`` are the former versions of replaced or withdrawn rows. A repeated batch changes nothing."""
        plus = moments(added, self.keys, self.value)
        minus = plus.limit(0) if removed is None else moments(removed, self.keys, self.value)
        first = self.snapshot.manifest()["schema"] is None
        change = plus if first else merged(self.snapshot.read(), plus, minus, self.keys)
        return self.snapshot.append(change, batch, "increment")
