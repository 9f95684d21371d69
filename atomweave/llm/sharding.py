"""Shards by minimax contiguous partition over ordered atomic groups.

Rows with equal texts form an atomic group. Groups are ordered by a 64-bit hash of their text; the smallest shard
capacity at which a greedy left-to-right fill needs no more than ``n_shards`` shards is found by binary search, and the
order is cut there. Groups larger than an even share come first in the order, each in a shard of its own, so that one
hot group doesn't raise the capacity of all others.

The ordered sizes are never gathered: the driver holds a tree of totals by the leading bits of the hash, and asks for
the 256 totals below a node only where a cut of a tried capacity falls into it. So each round of the search is a few
distributed aggregations over the groups, and what the driver receives depends on the number of shards, not on the data.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import documents, forget, written

#: Bits of the hash that one level of the tree of totals takes.
STEP = 8
#: Capacities that are tried at once.
WAYS = 16


class _Node:
    """The totals below one prefix of the hash, in order: where each begins, its prefix, number of groups and least key."""

    __slots__ = ("before", "keys", "n", "prefix")

    def __init__(self, start: int, rows: list) -> None:
        self.before, self.prefix, self.n, self.keys = [start], [], [], []
        for p, size, n, key in rows:
            self.before.append(self.before[-1] + size)
            self.prefix.append(p)
            self.n.append(n)
            self.keys.append(key)


class _Ordered:
    """Group sizes in order of key, as a tree of totals that grows where it is asked for."""

    def __init__(self, groups: DataFrame, skip: list[int]) -> None:
        self.groups = groups.where(~F.col("key").isin(skip)) if skip else groups
        self.nodes: dict[tuple[int, int], _Node] = {}
        self._load({(0, 0): 0})
        self.total = self.nodes[0, 0].before[-1]

    def _load(self, want: dict[tuple[int, int], int]) -> None:
        """Loads nodes (level, prefix), given the prefix sum at which each begins; one aggregation a level."""
        for level in sorted({at[0] for at in want}):
            start = {p: x for (at, p), x in want.items() if at == level}
            parts = self.groups.select("key", "size", _prefix(F.col("key"), level).alias("p"), _prefix(F.col("key"), level + 1).alias("q"))
            if level:
                asked = self.groups.sparkSession.createDataFrame([(p,) for p in start], "p long")
                parts = parts.join(F.broadcast(asked), "p")
            rows: dict[int, list] = {p: [] for p in start}
            for r in parts.groupBy("p", "q").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("key").alias("k")).orderBy("p", "q").collect():
                rows[r["p"]].append((r["q"], r["s"], r["n"], r["k"]))
            for p, x in rows.items():
                self.nodes[level, p] = _Node(start[p], x)

    def cut(self, start: int, capacity: int, missing: dict[tuple[int, int], int]) -> tuple[int, int | None]:
        """The end of a shard that begins at prefix sum ``start``, and the largest key it may hold.

        A node that isn't loaded is added to ``missing``; the end is then an estimate.
        """
        upto = start + capacity
        if upto >= self.total:
            return self.total, None
        at = (0, 0)
        while True:
            node = self.nodes[at]
            i = bisect_right(node.before, upto) - 1  # the child in which the first group stands that doesn't fit
            if node.n[i] == 1:
                return node.before[i], node.keys[i] - 1
            at = (at[0] + 1, node.prefix[i])
            if at not in self.nodes:
                missing[at] = node.before[i]
                return upto, 0

    def cuts(self, capacity: int, n: int, missing: dict) -> list[int] | None:
        """Last keys of all shards but the final one, or None if n shards of that capacity don't hold everything."""
        start, out = 0, []
        for _ in range(n):
            start, last = self.cut(start, capacity, missing)
            if last is None:
                return out
            out.append(last)
        return None

    def exact(self, tries: list[int], n: int) -> list[list[int] | None]:
        """cuts() of each capacity in ``tries``, after loading what they need, for all of them at once."""
        while True:
            missing: dict[tuple[int, int], int] = {}
            out = [self.cuts(c, n, missing) for c in tries]
            if not missing:
                return out
            self._load(missing)


def _prefix(key: Column, level: int) -> Column:
    """The leading level * STEP bits of the signed key, as a number that keeps its order."""
    return F.shiftright(key, 64 - level * STEP) if level else F.lit(0).cast("long")


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[list[int], list[int]]:
    """(keys of groups with a shard of their own, last key of each further shard but the final one).

    groups: key long (unique), size long and positive.
    """
    largest = [(r["key"], r["size"]) for r in groups.orderBy(F.desc("size"), "key").limit(n_shards).collect()]
    if not largest:
        return [], []
    rest, own = groups.agg(F.sum("size")).first()[0], []
    for key, size in largest:
        if len(own) < n_shards - 1 and size * (n_shards - len(own)) > rest:
            own.append(key)
            rest -= size
        else:
            break
    left = n_shards - len(own)
    order = _Ordered(groups, own)
    if not order.total:
        return own, []
    top = largest[len(own)][1] if len(own) < len(largest) else 0
    low, high = max(top, -(-order.total // left)), order.total // left + top
    while low < high:
        tries = sorted({low + (high - low) * k // (WAYS + 1) for k in range(1, WAYS + 1)} | {low})
        enough = [c for c, cuts in zip(tries, order.exact(tries, left), strict=True) if cuts is not None]
        high = min(enough, default=high)
        low = max([c + 1 for c in tries if c < high], default=low) if not enough or tries[0] < high else high
        order.nodes = {at: x for at, x in order.nodes.items() if at[0] < 2}  # what deeper nodes were asked for lies elsewhere now
    return own, order.exact([low], left)[0]


def shard(docs: DataFrame, n_shards: int = 40, cell_rows: int = 10_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs (doc_id, text).

    size: UTF-8 bytes of the text plus 16. Null and empty texts are one group. Rows with equal texts share a shard,
    whatever their ids; slots are gapless from 0 in each shard and count repeated rows and null ids one by one.
    Slots come from counts of cells (shard, hash of id and text), so no task holds a whole shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"))
    rows = written(rows, "shard-rows")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    own, cuts = minimax_cuts(groups, n_shards)
    forget(groups)
    key = F.col("key")
    later = F.lit(len(own)) + (F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < key)) if cuts else F.lit(0))
    at = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k).cast("long") for k in own]), key), F.lit(0).cast("long")) - 1, later) if own else later
    n_cells = max(1, math.ceil(rows.count() / cell_rows))
    placed = rows.select("doc_id", "size", "text_crc32", "key", at.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "key"), F.lit(n_cells)).alias("cell"))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    numbered = placed.withColumn("in_cell", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "key")))
    return numbered.join(before, ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("in_cell") - 1).alias("slot"))


def op7_sharding(spark, sf_dir):
    """Law: bytes. Equal texts stay together; shard sizes are near equal but for groups above an even share."""
    out = shard(documents(spark, sf_dir), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
