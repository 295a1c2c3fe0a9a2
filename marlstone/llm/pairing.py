"""Pairs within groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group of more members is split into parts of about so many, each of which meets the whole group in a task of its own.
PART = 1000


def pairs_within(members: DataFrame, by: list[str], key: str, one: str, two: str, also: Callable[[DataFrame, DataFrame], object] | None = None) -> DataFrame:
    """(by, one, two), one < two: the pairs of members of a group, for results that are pairs.

    Groups of one member go no further than a partial count. `also` is a further condition on the two sides.
    """
    many = members.groupBy(*by).agg(F.count("*").alias("_many")).where("_many > 1").select(*by, parts(F.col("_many")).alias("_parts"))
    return split_pairs(members.join(many, by), by, key, one, two, also)


def parts(members: Column) -> Column:
    return F.ceil(members / PART).cast("int")


def split_pairs(rows: DataFrame, by: list[str], key: str, one: str, two: str, also: Callable[[DataFrame, DataFrame], object] | None = None) -> DataFrame:
    """As pairs_within, of rows that have the number of their group's parts in _parts."""
    left = rows.withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int")).alias("l")
    right = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).alias("r")
    side = lambda tag: {c: F.col(f"{tag}.{c}") for c in rows.columns}
    on = F.col("l._part") == F.col("r._part")
    for c in by:
        on = on & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    on = on & (F.col(f"l.{key}") < F.col(f"r.{key}"))
    if also is not None:
        on = on & also(side("l"), side("r"))
    return left.join(right, on).select(*[F.col(f"l.{c}").alias(c) for c in by], F.col(f"l.{key}").alias(one), F.col(f"r.{key}").alias(two))
