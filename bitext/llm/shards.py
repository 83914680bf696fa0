"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with one key stay together.  Groups of one size are interchangeable, so the packing works on
how many groups have each size; d different sizes need at least d*d/2 bytes of data, which bounds what
the one packing task reads by the square root of the data.  Groups then look their shard up by size and rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitext.llm.common import running, staged, without

RESULT = ["shard", "slot"]
SLACK = 1e-5  # capacities are told apart to this share


class Rooms:
    """Open bins in a balanced search tree by (room left, bin): a treap with hashed priorities."""

    def __init__(self) -> None:
        self.root = None

    @classmethod
    def _split(cls, node, key):
        if node is None:
            return None, None
        at, rank, left, right = node
        if at < key:
            a, b = cls._split(right, key)
            return (at, rank, left, a), b
        a, b = cls._split(left, key)
        return a, (at, rank, b, right)

    @classmethod
    def _join(cls, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return (a[0], a[1], a[2], cls._join(a[3], b))
        return (b[0], b[1], cls._join(a, b[2]), b[3])

    def add(self, room: int, bin_: int) -> None:
        key = (room, bin_)
        a, b = self._split(self.root, key)
        self.root = self._join(self._join(a, (key, hash(key) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFF, None, None)), b)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest bin with room for ``size``; None where there is none."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        _, rest = self._split(high, (node[0][0], node[0][1] + 1))
        self.root = self._join(low, rest)
        return node[0]


def best_fit(sizes: list[tuple[int, int]], capacity: int, limit: int | None = None, first: int = 0):
    """Runs (size, rank from, rank to, bin) of best-fit-decreasing over (size, count), descending; None if over ``limit`` bins."""
    rooms, runs, bins = Rooms(), [], 0
    for size, count in sizes:
        rank = 0
        while rank < count:
            found = rooms.take(size)
            if found is None:
                if bins == limit:
                    return None
                found = (capacity, first + bins)
                bins += 1
            room, bin_ = found
            # The tightest bin stays the tightest while it has room for the same size.
            many = min(count - rank, room // size if size else count)
            if not many:
                raise ValueError(f"A group of size {size} exceeds the capacity {capacity}.")
            runs.append((size, rank, rank + many, bin_))
            rooms.add(room - many * size, bin_)
            rank += many
    return runs


def equal_bins(sizes: list[tuple[int, int]], bins: int):
    """Runs over at most ``bins`` bins of the least common capacity found; groups over a fair share get a bin of their own."""
    sizes, runs, own = sorted(sizes, reverse=True), [], 0
    total = sum(s * c for s, c in sizes)
    taken = 0
    while own < bins - 1 and sizes and sizes[0][0] * (bins - own) > total:
        size, count = sizes[0]
        runs.append((size, taken, taken + 1, own))
        own, total, taken = own + 1, total - size, taken + 1
        if taken == count:
            sizes, taken = sizes[1:], 0
    skip = {sizes[0][0]: taken} if taken else {}
    if skip:
        sizes = [(sizes[0][0], sizes[0][1] - taken), *sizes[1:]]
    if not sizes:
        return runs
    fair = max(-(-total // (bins - own)), sizes[0][0])
    low, step, found = fair, 0, None
    while found is None:
        found, high = best_fit(sizes, fair + step, bins - own, own), fair + step
        low, step = (low, step) if found else (high + 1, max(1, 2 * step, int(fair * SLACK)))
    while high - low > fair * SLACK:
        middle = (low + high) // 2
        if better := best_fit(sizes, middle, bins - own, own):
            found, high = better, middle
        else:
            low = middle + 1
    return runs + [(s, a + skip.get(s, 0), b + skip.get(s, 0), k) for s, a, b, k in found]


def shard_groups(
    docs: DataFrame, key: Column, size: Column, shards: int | None = 24, capacity: int | None = None, id: str = "doc_id"
) -> DataFrame:
    """The rows of ``docs`` with shard (from 0) and slot (place in the shard, from 0 without gaps).

    Either ``shards`` of near equal size, or as few shards of ``capacity`` as best-fit-decreasing needs. Rows
    with equal ``key`` share a shard and stand side by side; null is a key like any other.  Null sizes count as 0, negative
    ones too.  A group over the capacity ends the job with an error; with ``shards``, a group over its fair share has a
    shard of its own.  Rows with one identifier, or none, and repeated rows are rows of their own.  Columns named like a
    result column give way.  An empty table gives an empty one.
    """
    kept = without(docs, RESULT)
    rows = docs.select(
        F.struct(*kept).alias("row"), key.alias("g"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("size"),
        F.col(id).alias("id"), F.xxhash64(*kept).alias("tie"),
    )
    ranked = staged(running(rows, ["g"], ["id", "tie"], {"nth": F.lit(1)}, "rows"), "rows")
    groups = ranked.groupBy("g").agg(F.sum("size").alias("weight"))
    groups = staged(running(groups, ["weight"], ["g"], {"rank": F.lit(1)}, "groups"), "groups")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat([pd.DataFrame({"weight": [], "groups": []}, dtype="int64"), *batches])
        sizes = sorted(zip(whole["weight"].tolist(), whole["groups"].tolist(), strict=True), reverse=True)
        runs = best_fit(sizes, capacity) if capacity else equal_bins(sizes, shards)
        yield pd.DataFrame(runs, columns=["w", "low", "high", "shard"]).astype({"w": "int64", "low": "int64", "high": "int64", "shard": "int32"})

    histogram = groups.groupBy("weight").agg(F.count(F.lit(1)).alias("groups"))
    places = staged(histogram.coalesce(1).mapInPandas(place, "w long, low long, high long, shard int"), "places")
    placed = groups.join(places, (F.col("weight") == F.col("w")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.select(F.col("g").alias("h"), "shard")
    sharded = ranked.join(placed, F.col("g").eqNullSafe(F.col("h"))).select("row", "shard", "g", "nth")
    return running(sharded, ["shard"], ["g", "nth"], {"slot": F.lit(1)}, "slots").select("row.*", "shard", "slot")
