"""Graphs as edge tables (src, dst): closure, reachability, hops, cliques and weighted flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settled


def reachable(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """node, hops: every node that seeds (node) reach, with the least number of hops. Each round expands the new nodes only."""
    edges = edges.select("src", "dst").distinct()
    front = settled(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    seen, hop = front, 0
    while most is None or hop < most:
        hop += 1
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = settled(step.withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def closure(edges: DataFrame) -> DataFrame:
    """src, dst: all pairs with a path between them, by semi-naive rounds: only new pairs are joined again, from both ends."""
    base = settled(edges.select("src", "dst").distinct())
    seen = new = base
    while True:
        step = new.join(base.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst")).distinct()
        new = settled(step.join(seen, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = settled(seen.union(new))


def k_hop(edges: DataFrame, k: int) -> DataFrame:
    """src, dst: endpoints of walks of k edges; endpoints are made distinct at every hop, so walks don't multiply."""
    edges = edges.select("src", "dst").distinct()
    out = edges
    for _ in range(k - 1):
        out = out.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst")).distinct()
    return out


def cliques(edges: DataFrame, k: int) -> DataFrame:
    """c1 < … < ck of all cliques of an undirected graph.

    Edges point from the node of smaller degree to the other, which bounds the wedges, and each new member must be joined to
    all others, so no open path is kept.
    """
    both = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    degree = both.select(F.col("a").alias("n")).union(both.select(F.col("b").alias("n"))).groupBy("n").agg(F.count("*").alias("d"))
    da, db = degree.select(F.col("n").alias("a"), F.col("d").alias("da")), degree.select(F.col("n").alias("b"), F.col("d").alias("db"))
    ranked = both.join(da, "a").join(db, "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    arcs = settled(ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("p"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("q")))
    out = arcs.select(F.col("p").alias("m1"), F.col("q").alias("m2"))
    for n in range(3, k + 1):
        out = out.join(arcs.select(F.col("p").alias("m1"), F.col("q").alias(f"m{n}")), "m1")
        for i in range(2, n):
            out = out.join(arcs.select(F.col("p").alias(f"m{i}"), F.col("q").alias(f"m{n}")), [f"m{i}", f"m{n}"], "left_semi")
    members = F.array_sort(F.array(*[F.col(f"m{i}") for i in range(1, k + 1)]))
    return out.select(*[members[i].alias(f"c{i + 1}") for i in range(k)])


def flow(edges: DataFrame, seeds: DataFrame, share: float, most: int = 30) -> DataFrame:
    """node, round: spread over weighted edges (src, dst, w): a node joins when reached nodes make up at least ``share`` of its input."""
    total = edges.groupBy("dst").agg(F.sum("w").alias("total"))
    seen = settled(seeds.select("node").distinct().withColumn("round", F.lit(0)))
    for n in range(1, most + 1):
        into = edges.join(seen.select(F.col("node").alias("src")), "src", "left_semi").groupBy("dst").agg(F.sum("w").alias("got"))
        new = into.join(total, "dst").where(F.col("got") >= F.lit(share) * F.col("total")).select(F.col("dst").alias("node")).join(seen, "node", "left_anti")
        new = settled(new.withColumn("round", F.lit(n)))
        if new.isEmpty():
            break
        seen = settled(seen.union(new))
    return seen
