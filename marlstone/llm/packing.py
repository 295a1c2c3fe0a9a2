"""Filling containers of fixed capacity with texts, planned on the histogram of their lengths.

Texts longer than a container are cut into full pieces and a rest. The plan never sees a text: it places counts of equal
lengths, longest first, each into the containers with the least space that holds it. Every planned slot is a range of ranks
within a length; texts take their slots by joining on their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import tokens
from marlstone.session import settle

#: Ranks within one length are counted in parts of about so many items in all, at least LEAST_PARTS, so that no length is ranked in one task.
PART_ITEMS, LEAST_PARTS = 100_000, 64
#: Plans of fewer slots are broadcast; a plan's size is bounded by the capacity, not by the number of texts.
BROADCAST_SLOTS = 100_000
PLAN = "capacity_id int, length int, rank_from bigint, slots bigint, container_from bigint, per_container int"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts: (length, first rank, items, first container, items per container).

    Item number k of a slot range goes into container first + k // items per container.
    """
    out: list[tuple[int, int, int, int, int]] = []
    free: dict[int, deque[list[int]]] = {}  # space left: ranges [first container, number]
    spaces: list[int] = []
    opened = 0

    def give(space: int, first: int, n: int) -> None:
        if space <= 0 or n <= 0:
            return
        if space not in free:
            free[space] = deque()
            insort(spaces, space)
        free[space].append([first, n])

    for length in sorted((x for x in counts if x > 0), reverse=True):
        if length > capacity:
            raise ValueError("longer than the capacity")
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                per = capacity // length
                full, rest = divmod(left, per)
                if full:
                    out.append((length, rank, full * per, opened, per))
                    give(capacity - per * length, opened, full)
                    opened, rank = opened + full, rank + full * per
                if rest:
                    out.append((length, rank, rest, opened, rest))
                    give(capacity - rest * length, opened, 1)
                    opened += 1
                break
            space = spaces[at]
            first, n = free[space][0]
            take = min(n, left)
            if take == n:
                free[space].popleft()
                if not free[space]:
                    del free[space]
                    spaces.pop(at)
            else:
                free[space][0] = [first + take, n - take]
            out.append((length, rank, take, first, 1))
            give(space - length, first, take)
            rank, left = rank + take, left - take
    return out


def pieces(sizes: DataFrame, capacities: DataFrame, key: str) -> DataFrame:
    """(capacity_id, capacity_tokens, key, piece, tokens): each text's pieces for each capacity; no piece exceeds it."""
    both = sizes.where("tokens > 0").select(key, "tokens").join(F.broadcast(capacities.select("capacity_id", "capacity_tokens")), F.col("capacity_tokens") > 0)
    full, rest = F.floor(F.col("tokens") / F.col("capacity_tokens")), F.col("tokens") % F.col("capacity_tokens")
    n = full + (rest > 0).cast("bigint")
    cut = both.select("capacity_id", "capacity_tokens", key, rest.alias("rest"), full.alias("full"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("piece"))
    return cut.select("capacity_id", "capacity_tokens", key, F.col("piece").cast("int").alias("piece"), F.when(F.col("piece") < F.col("full"), F.col("capacity_tokens")).otherwise(F.col("rest")).cast("int").alias("tokens"))


def containers(sizes: DataFrame, capacities: DataFrame, key: str = "doc_id") -> DataFrame:
    """(capacity_id, key, piece, tokens, container): the container of every text or piece, for every capacity.

    sizes has key and tokens. A text of no tokens takes no space and gets the row (piece 0, tokens 0, container null). Rows
    that repeat a key are texts of their own. Capacities that are null or not above zero are left out.
    """
    spark = sizes.sparkSession
    items = settle(pieces(sizes, capacities, key), "pieces")
    salts = max(LEAST_PARTS, -(-items.count() // PART_ITEMS))
    items = items.withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)))
    parts = items.groupBy("capacity_id", "capacity_tokens", F.col("tokens").alias("length"), "salt").agg(F.count("*").alias("n"))
    parts = settle(parts, "lengths")
    # at most one row for each length up to the capacity comes to the driver
    histogram: dict[tuple[int, int], dict[int, int]] = {}
    for r in parts.groupBy("capacity_id", "capacity_tokens", "length").agg(F.sum("n").alias("n")).collect():
        histogram.setdefault((r.capacity_id, r.capacity_tokens), {})[r.length] = r.n
    slots = [(i, *s) for (i, c), counts in histogram.items() for s in plan(counts, c)]
    planned = spark.createDataFrame([(i, length, rank, n, first, per) for i, length, rank, n, first, per in slots], PLAN)
    before = F.sum("n").over(Window.partitionBy("capacity_id", "length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("capacity_id", "length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = items.withColumn("length", F.col("tokens")).withColumn("k", F.row_number().over(Window.partitionBy("capacity_id", "length", "salt").orderBy(key, "piece")) - 1)
    ranked = ranked.join(offsets, ["capacity_id", "length", "salt"]).withColumn("rank", F.col("before") + F.col("k"))
    taken = ranked.join(F.broadcast(planned) if len(slots) < BROADCAST_SLOTS else planned, ["capacity_id", "length"]).where((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_from") + F.col("slots")))
    placed = taken.select("capacity_id", key, "piece", "tokens", (F.col("container_from") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("per_container"))).alias("container"))
    empty = sizes.where("tokens = 0").select(key).join(F.broadcast(capacities.where("capacity_tokens > 0").select("capacity_id"))).select("capacity_id", key, F.lit(0).alias("piece"), F.lit(0).alias("tokens"), F.lit(None).cast("bigint").alias("container"))
    return placed.unionByName(empty)


def pack_texts(docs: DataFrame, capacities: DataFrame, key: str = "doc_id", text: str = "text", **vocabulary) -> DataFrame:
    """Containers of texts by their tokens of a public vocabulary; null and empty texts have none."""
    return containers(settle(tokens.count(docs, key, text, **vocabulary), "sizes"), capacities, key)


def fill(placed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, containers, items, tokens, least_containers, fill_share): how full the containers are."""
    used = placed.where("container is not null").groupBy("capacity_id").agg((F.max("container") + 1).alias("containers"), F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    return used.join(F.broadcast(capacities.select("capacity_id", "capacity_tokens")), "capacity_id").select("capacity_id", "containers", "items", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill_share"))
