"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow whose rate is its target. Its documents, shuffled by a seeded hash of ids and texts, get virtual
finish times: words of the source so far, repeats included, divided by the target. All copies are sorted by finish time
and cut at the total budget. At virtual time t every flow has been served t times its target, so the cut falls at 1 and
each source is within one document of its target.

Running totals are taken in two levels (totals of hash buckets, then rows of one bucket), so that a source with a third
of all rows, or the whole queue, never meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import documents, n_words, written

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BUCKET_ROWS = 5_000


def fair_targets(sizes: list[int], weights: list[float], budget: float, max_epochs: int = MAX_EPOCHS) -> list[float]:
    """Shares of the budget by weight, none above max_epochs times its size; the excess is shared again by weight."""
    targets, active, rest = [0.0] * len(sizes), list(range(len(sizes))), float(budget)
    while active:
        total = sum(weights[i] for i in active)
        share = {i: rest * weights[i] / total for i in active}
        full = [i for i in active if share[i] > max_epochs * sizes[i]]
        if not full:
            for i in active:
                targets[i] = share[i]
            break
        for i in full:
            targets[i] = float(max_epochs * sizes[i])
            rest -= targets[i]
        active = [i for i in active if share[i] <= max_epochs * sizes[i]]
    return targets


def shuffle_hash(doc_id: Column, text: Column, seed: int = 17) -> Column:
    """What the rows of a source are shuffled by."""
    return F.xxhash64(doc_id, text, F.lit(seed))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """doc_id and source of each row of docs (doc_id, text, source), in addition: h, size, source_size, target, taken, finish.

    size: words of the text (null: 0). Sources in code-point order, null last, get the weights in turn; their number
    is what the driver holds. taken: size times the copies in the mix. finish: virtual finish time of the first copy.
    h: the hash of doc_id and text that shuffles the rows of a source. Null, empty and blank texts have no words and take
    nothing. Rows that share a doc_id, or repeat, are separate rows. Reruns give the same mix.
    """
    spark = docs.sparkSession
    rows = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), shuffle_hash(F.col("doc_id"), F.col("text"), seed).alias("h")), "mix-sizes")
    stats = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    stats.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    budget = sum(r["size"] for r in stats)
    targets = fair_targets([r["size"] for r in stats], [weights[i % len(weights)] for i in range(len(stats))], budget, max_epochs)
    table = [(i, r["source"], r["size"], t, max(1, math.ceil(r["n"] / BUCKET_ROWS))) for i, (r, t) in enumerate(zip(stats, targets, strict=True))]
    sources = spark.createDataFrame(table, "sid int, s string, source_size long, target double, buckets long")
    keyed = rows.join(sources, rows["source"].eqNullSafe(sources["s"])).select("doc_id", "source", "size", "h", "sid", "source_size", "target", F.pmod("h", "buckets").alias("b"))
    sums = keyed.groupBy("sid", "b").agg(F.sum("size").alias("w"))
    before = sums.select("sid", "b", (F.sum("w").over(Window.partitionBy("sid").orderBy("b")) - F.col("w")).alias("before"))
    in_bucket = Window.partitionBy("sid", "b").orderBy("h", "doc_id", "size")
    queued = keyed.withColumn("done", F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(in_bucket))
    queued = queued.join(before, ["sid", "b"]).withColumn("done", F.col("done") + F.col("before"))
    started = (F.col("e") * F.col("source_size") + F.col("done") - F.col("size")) < F.col("target")
    copies = queued.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("e")).where((F.col("e") == 0) | started)
    copies = copies.withColumn("runs", started & (F.col("size") > 0)).withColumn("finish", (F.col("e") * F.col("source_size") + F.col("done")) / F.nullif(F.col("target"), F.lit(0.0)))
    n_slots = max(1, math.ceil(sum(r["n"] for r in stats) / BUCKET_ROWS))
    copies = copies.withColumn("slot", F.when(F.col("finish") <= 1.0, F.floor(F.least(F.col("finish"), F.lit(1.0)) * n_slots)).otherwise(F.lit(n_slots + 1)))
    copies = copies.withColumn("w", F.when(F.col("runs"), F.col("size")).otherwise(F.lit(0))).withColumn("salt", F.when(F.col("runs"), F.lit(0)).otherwise(F.pmod("h", F.lit(n_slots)) + 1))
    copies = written(copies.select("doc_id", "source", "size", "sid", "source_size", "target", "b", "rn", "h", "e", "runs", "finish", "slot", "w", "salt"), "mix-queue", sum(r["n"] for r in stats) * max_epochs * 120)
    slots = copies.groupBy("slot").agg(F.sum("w").alias("sw"))
    slots = slots.select("slot", (F.sum("sw").over(Window.orderBy("slot")) - F.col("sw")).alias("ahead"))
    queue = Window.partitionBy("slot", "salt").orderBy("finish", "h", "doc_id", "sid", "b", "rn", "e")
    served = copies.withColumn("served", F.sum("w").over(queue.rowsBetween(Window.unboundedPreceding, 0))).join(slots, "slot")
    take = F.col("runs") & (F.col("served") + F.col("ahead") <= budget)
    out = served.groupBy("sid", "b", "rn").agg(
        F.first("doc_id").alias("doc_id"), F.first("h").alias("h"), F.first("source").alias("source"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum(F.when(take, F.col("size")).otherwise(F.lit(0))).alias("taken"), F.min("finish").alias("finish"),
    )
    return out.select("doc_id", "source", "h", "size", "source_size", "target", "taken", "finish")


def op4_mixing(spark, sf_dir):
    """Sources by weights 1, 2, 3 in turn; budget: all words."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "finish")
