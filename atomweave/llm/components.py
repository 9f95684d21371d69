"""Connected components of a table of links: by union-find in one task, or if there are many links by smallest-label
propagation with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import forget, importable, spread_join, written

#: Links that one task joins.
FEW = 100_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            root[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(root, pa.int64()), pa.array([find(x) for x in root], pa.int64())], ["id", "component"])


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """id, component (smallest id that can be reached) for every id in links (a, b), written to the shared folder.

    links is read more than once, so it should be a written table. Up to ``few`` links are joined in one task, more in
    rounds, each written to the shared folder. Links and labels stay distributed; the driver sees counts. Each round takes the least label of the neighbours and
    then the label's own label, so long chains halve. The many rows of a hub or of a large component's root are not
    shuffled to one task.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    n = links.count()
    if n <= few:
        importable(links.sparkSession)
        return written(links.coalesce(1).mapInArrow(_joined, "id long, component long"), "labels")
    size = 2 * n * 32
    both = written(links.union(links.select("b", "a")).distinct(), "links", size)
    n_both = both.count()
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"), F.count("*").alias("degree"))
    labels = written(labels.select("id", F.least("id", "m").alias("component"), "degree"), "labels", size)
    n_ids = labels.count()
    while True:
        far = spread_join(both.withColumnRenamed("b", "id"), labels, ["id"], "degree", n_both)
        near = far.groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.least("component", "m").alias("c"), F.col("component").alias("old"), "degree")
        step = written(step, "labels-step", size)
        roots = step.groupBy("c").agg(F.count("*").alias("n"))
        jump = roots.join(step.select(F.col("id").alias("c"), F.col("c").alias("next")), "c")
        moved = spread_join(step, jump, ["c"], "n", n_ids).select("id", F.least("c", "next").alias("component"), "old", "degree")
        moved = written(moved, "labels", size)
        changed = moved.where(F.col("component") != F.col("old")).limit(1).count()
        forget(step, labels)
        labels = moved.select("id", "component", "degree")
        if not changed:
            forget(both)
            return labels.select("id", "component")
