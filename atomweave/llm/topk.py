"""Exact top-k inner-product search by MaxScore.

Terms are dimensions. A shard shifts each term's contribution so that none is negative: for query weight q and the
shard's least and greatest value of the term, the score bound of the term is max(q*lo, q*hi) - min(q*lo, q*hi). Terms
are sorted by bound; against the running k-th score, those whose bounds can't lift a candidate over it by themselves
are non-essential. Essential postings are traversed for all candidates of the shard, the others are probed, a few terms at
a time, only for candidates that are still competitive. A block of queries shares the order of terms and the traversal;
bounds and k-th scores are each query's own. Shards' lists are merged by score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import importable

PROBE = 8


TOP = 2**63 - 1


def _pack(df: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of rows whose vectors have one length: blk, ids binary (int64), m binary (int64, row-major), dim."""

    def pack(batches):
        for b in batches:
            ids, lists = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1)
            dims = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                for s in range(0, len(rows), block_rows):
                    part = rows[s : s + block_rows]
                    m = lists.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[part].tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([int(dim)], pa.int32())], ["ids", "m", "dim"])

    return df.mapInArrow(pack, "ids binary, m binary, dim int").withColumn("blk", F.monotonically_increasing_id())


def maxscore(queries: np.ndarray, qids: np.ndarray, docs: np.ndarray, ids: np.ndarray, k: int):
    """(query id, id, score) of the k best of each query of a block in one shard, ties to the smaller id, the query's own left out."""
    order = np.argsort(ids, kind="stable")
    docs, ids = docs[order], ids[order]
    widest = [max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (queries, docs)]
    exact = widest[0] * widest[1] * docs.shape[1] < 2**53
    kind = np.float64 if exact else object  # products of great integers need Python's
    q, d = queries.astype(kind), docs.astype(kind)
    a, b = q * d.min(0), q * d.max(0)
    up, low = np.maximum(a, b), np.minimum(a, b)
    terms = np.argsort(-(up - low).sum(0), kind="stable")
    q, d = q[:, terms], d[:, terms]
    zero = np.zeros((len(q), 1), kind)
    most = np.concatenate([np.cumsum(up[:, terms][:, ::-1], 1)[:, ::-1], zero], 1)  # what terms i.. can add at most
    least = np.concatenate([np.cumsum(low[:, terms][:, ::-1], 1)[:, ::-1], zero], 1)
    own = qids[:, None] == ids[None, :]
    theta = np.full(len(q), -np.inf if exact else -(2**200), kind)
    n_terms, spare = d.shape[1], k + int(own.sum(1).max(initial=0))

    def lift(known: np.ndarray) -> None:
        """The running k-th score from sums that are reached for certain; own rows count as passed over."""
        if known.shape[1] >= spare:
            np.maximum(theta, np.partition(known, known.shape[1] - spare, 1)[:, known.shape[1] - spare], out=theta)
            if not exact:  # what a long can't hold counts as the nearest one, so such scores tie
                theta[theta > TOP] = TOP
                theta[theta <= -TOP - 1] = -(2**200)

    lift(q @ d[:: max(1, len(d) // (8 * spare))].T)
    # terms are essential until, for the median query, the rest can't reach the k-th score by themselves
    split = int(np.clip(np.median((most[:, :-1] >= theta[:, None]).sum(1)), 1, n_terms))
    score = q[:, :split] @ d[:, :split].T
    if split < n_terms:
        lift(score + least[:, split : split + 1])
    rows, cols = np.nonzero((score + most[:, split : split + 1] >= theta[:, None]) & ~own)
    left = score[rows, cols]
    for at in range(split, n_terms, PROBE):
        step = slice(at, min(at + PROBE, n_terms))
        left = left + (q[rows, step] * d[cols, step]).sum(1)
        stay = left + most[rows, step.stop] >= theta[rows]
        rows, cols, left = rows[stay], cols[stay], left[stay]
    if not exact:
        left = np.array([min(max(x, -TOP - 1), TOP) for x in left.tolist()], object)
    best = np.lexsort((ids[cols], -left, rows)) if exact else np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -left[i], ids[cols[i]])), np.int64)
    rows, cols, left = rows[best], cols[best], left[best]
    first = np.searchsorted(rows, rows)
    top = np.arange(len(rows)) - first < k
    return qids[rows[top]], ids[cols[top]], left[top].astype(np.int64)


def top_k(queries: DataFrame, docs: DataFrame, k: int = 20, doc_block: int = 10_000, query_block: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest integer inner products of each query, ties to the smaller vec_id.

    Both sides: vec_id long, v array<long>, without nulls. Of two vectors the shorter one counts as filled up with
    zeros. A query's own id is left out. Rows that share an id count one by one. A score that a long can't hold counts
    as the nearest long. Each task holds one block of candidates and one of queries.
    """
    spark = docs.sparkSession
    importable(spark)
    n = docs.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = _pack(docs.select("vec_id", "v"), doc_block).select(F.col("blk").alias("dblk"), F.col("ids").alias("dids"), F.col("m").alias("dm"), F.col("dim").alias("ddim"))
    parts = max(1, math.ceil(queries.count() / query_block))
    asked = _pack(queries.select("vec_id", "v").repartitionByRange(parts, "vec_id"), query_block).select(F.col("ids").alias("qids"), F.col("m").alias("qm"), F.col("dim").alias("qdim"))
    # the stated queries against all rows, block by block: candidates are dealt once, each query block goes to every slice of them
    slices = max(1, math.ceil(n / doc_block))
    shards = shards.withColumn("slice", F.pmod(F.xxhash64("dblk"), F.lit(slices)))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"))

    def search(batches):
        for b in batches:
            for qi, qm, qd, di, dm, dd in zip(*(c.to_pylist() for c in b.columns), strict=True):
                qids, ids, m = np.frombuffer(qi, np.int64), np.frombuffer(di, np.int64), min(qd, dd)
                got = maxscore(np.frombuffer(qm, np.int64).reshape(len(qids), qd)[:, :m], qids, np.frombuffer(dm, np.int64).reshape(len(ids), dd)[:, :m], ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], ["query_id", "vec_id", "score"])

    found = asked.join(shards, "slice").select("qids", "qm", "qdim", "dids", "dm", "ddim").mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def quantised(df: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component as a double; rows with a null id, vector or component, or one that isn't finite, are left out."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    ok = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    kept = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def op10_topk(spark, sf_dir):
    """Queries: every vec_id divisible by 20; candidates: all other rows."""
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows.where(F.col("vec_id") % 20 == 0), rows, 20)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
