"""As-of and interval joins without nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """left and, of right, the values of the last row of equal keys that isn't later; null where there is none.

    Both sides are put in one order by a union and the values carried forward, one shuffle by the keys in all. Of right rows
    of equal keys and moment any one counts. A null key or moment finds nothing.
    """
    pick = F.struct(*values)
    both = left.select(*keys, F.col(at).alias("_at"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(pick.alias("x")).schema[0].dataType).alias("_r"), F.lit(1).alias("_side"))
    both = both.unionByName(right.select(*keys, F.col(at).alias("_at"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema[0].dataType).alias("_l"), pick.alias("_r"), F.lit(0).alias("_side")))
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_v", F.last("_r", True).over(w)).where("_side = 1")
    known = F.col("_at").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    return seen.select("_l.*", *[F.when(known, F.col("_v")[v]).alias(v) for v in values])


def within(left: DataFrame, right: DataFrame, keys: list[str], at: str, other_at: str, seconds: int) -> DataFrame:
    """Pairs of equal keys whose right moment is at most so many seconds before the left one.

    Moments are cut into slots of that length: a left row looks in its own slot and the one before, so that the join is an
    equi-join on keys and slot, which splits where it is skewed.
    """
    slot = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    a = left.withColumn("_slot", F.explode(F.array(slot(at), slot(at) - 1)))
    b = right.withColumn("_slot", slot(other_at))
    return a.join(b, [*keys, "_slot"]).where((F.col(other_at) <= F.col(at)) & (F.col(other_at) >= F.col(at) - F.make_dt_interval(secs=F.lit(seconds)))).drop("_slot")
