"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct shingles of consecutive lower-cased words. Each register holds a truncated,
exponentially spaced minimum: of m hash functions the least value x over the set gives floor(1 - log_b(x)), so sketches
of unions are element-wise maxima, and two registers are equal with a probability close to the Jaccard similarity.
Bands of registers name candidates. A candidate pair's similarity is estimated from the counts of greater, smaller and
equal registers by maximum likelihood, given both set sizes; pairs that may reach the threshold are confirmed on the
full sets.

Equal sets are one class before anything else. Inside a bucket each member is first held against the bucket's smallest
id. Only what that leaves apart goes on: pairs of different components in small buckets one by one, and members of
large buckets in blocks, where a task compares one block with another on the full sets and gives back links that span,
not all pairs. So no link between different texts is lost and no group is turned into all its pairs.

With 32 bands of 4 registers a pair at similarity 0.8 shares no band with probability 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, forget, importable, integer_ids, slices, spread_join, written
from .components import components
from .substrings import Hashes, windows

BANDS, ROWS = 32, 4
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
#: Pairs whose estimate is below the threshold by more than this (7 standard errors) are not confirmed.
MARGIN = 0.25
SMALL_BUCKET, BLOCK = 24, 128
_SEEDS = np.random.default_rng(20240229)
_A = _SEEDS.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEEDS.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2)
_WORDS = Hashes()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; with fewer words the whole sequence is one."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(windows(_WORDS(words), min(width, len(words))))


def sketch(s: np.ndarray) -> np.ndarray:
    """Registers (uint16) of a set that isn't empty."""
    least = np.full(len(_A), 2**64 - 1, np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(least, (s[at : at + 2048, None] * _A + _B).min(0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 1.0) / (2.0**64 + 2.0)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row of registers."""
    packed = np.ascontiguousarray(registers).view(np.uint64).reshape(len(registers), BANDS)
    k = (packed ^ (np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    k ^= k >> np.uint64(31)
    return (k * np.uint64(0x94D049BB133111EB)).view(np.int64)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches, given the set sizes."""
    more, less, same = (ra > rb).sum(1)[:, None], (ra < rb).sum(1)[:, None], (ra == rb).sum(1)[:, None]
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    j = np.linspace(0, 1, 129)[None, :] * np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    a, b = p(u - v * j), p(v - u * j)
    eps = 1e-12
    like = more * np.log(a + eps) + less * np.log(b + eps) + same * np.log(np.maximum(1 - a - b, 0) + eps)
    return np.take_along_axis(j, like.argmax(1)[:, None], 1)[:, 0]


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[] for _ in range(4)]
            for text in b.column(1).to_pylist():
                s = shingles(text, width)
                f = xxhash.xxh3_128_intdigest(s.tobytes())
                for col, x in zip(out, (len(s), (f & (2**64 - 1)) - 2**63, (f >> 64) - 2**63, sketch(s).tobytes() if len(s) else None), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], ["doc_id", "n", "f1", "f2", "regs"])

    return run


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        if b.num_rows:
            regs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, -1)
            ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(band_keys(regs).ravel(), pa.int64())], ["id", "key"])


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if b.num_rows:
                ra, rb = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(b.num_rows, -1) for i in (2, 3))
                na, nb = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (4, 5))
                yield b.select([0, 1]).filter(pa.array(estimate(ra, rb, na, nb) >= least))

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, great = min(len(s), len(t)), max(len(s), len(t))
                common = len(np.intersect1d(s, t, assume_unique=True)) if 100 * small >= percent * great else 0
                ok.append(100 * common >= percent * (len(s) + len(t) - common))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _set_bytes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([shingles(t, width).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["id", "s"])

    return run


def spanning(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members with different labels that join all components which the full sets link."""
    n, sizes = len(ids), np.array([len(s) for s in sets])
    values, who = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, at, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    col = np.cumsum(shared) - 1
    pick = shared[at]
    cols, who = col[at[pick]], who[pick]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(cols, kind="stable")
    cols, who = cols[order], who[order]
    for start in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(cols, (start, start + 4096))
        x = np.zeros((n, 4096), np.float32)
        x[who[lo:hi], cols[lo:hi] - start] = 1
        common += x @ x.T
    c = common.astype(np.int64)
    linked = np.triu(100 * c >= percent * (sizes[:, None] + sizes[None, :] - c), 1) & (labels[:, None] != labels[None, :])
    root = {x: x for x in labels.tolist()}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = find(int(labels[i])), find(int(labels[j]))
        if a != b:
            root[b] = a
            out.append((int(ids[i]), int(ids[j])))
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Documents are linked if 100 * common shingles >= percent * shingles of the union. component_id is the smallest
    doc_id that can be reached, kept is doc_id = component_id. Null, empty and blank texts are linked with nothing, very
    long ones are taken whole. Rows with a null doc_id are linked with nothing, have a null component_id and are kept.
    Texts that share a doc_id are linked with one another, so all of them have one component; rows that repeat both are
    alike. doc_id must be an integer.
    """
    spark = docs.sparkSession
    importable(spark)
    docs = integer_ids(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(docs.mapInArrow(_sets(width), "doc_id long, n long, f1 long, f2 long, regs binary"), "sets")
    n_sets, words = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    full = sets.where("doc_id IS NOT NULL AND n > 0")
    classes = written(full.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes", n_sets * 40)
    # the id is a key as well, so the copies of a class don't meet
    of_rep = (full["f1"] == classes["f1"]) & (full["f2"] == classes["f2"]) & (full["doc_id"] == classes["rep"])
    reps = full.join(classes, of_rep).select(F.col("rep").alias("id"), "n", "regs")
    reps = written(reps.dropDuplicates(["id", "n", "regs"]), "reps", n_sets * 300)
    rows = reps.select("id", "regs").mapInArrow(_band_rows, "id long, key long")
    n_rows = reps.count() * BANDS
    buckets = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("lead"), F.max("id").alias("tail")).where("lead < tail")
    buckets = written(buckets.drop("tail"), "buckets", n_rows * 12)
    members = written(spread_join(rows, buckets, ["key"], "size", n_rows), "members", n_rows * 32)
    n_members = members.count()
    ids = members.select("id").distinct()
    chosen = docs.join(ids, docs["doc_id"] == ids["id"], "left_semi")
    full_sets = written(chosen.mapInArrow(_set_bytes(width), "id long, s binary").dropDuplicates(), "full-sets", words * 8 + n_sets * 16)

    def confirm(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that are links: estimate first, then the full sets."""
        size = pairs.count() * 600
        for side in ("a", "b"):
            pairs = pairs.join(reps.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("regs").alias(f"r{side}")), side)
        likely = written(pairs.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(_likely(percent / 100 - MARGIN), "a long, b long"), "likely", size)
        size = likely.count() * (16 + 16 * words // max(1, n_sets))
        out = likely
        for side in ("a", "b"):
            out = out.join(full_sets.select(F.col("id").alias(side), F.col("s").alias(f"s{side}")), side)
        out = written(out.select("a", "b", "sa", "sb").mapInArrow(_confirmed(percent), "a long, b long"), "links", size)
        forget(likely)
        return out

    # a doc_id with several texts is in several classes
    several = full.groupBy("doc_id").agg(F.min(F.struct("f1", "f2")).alias("x"), F.max(F.struct("f1", "f2")).alias("y")).where("x <> y").select("doc_id")
    same = full.join(several, "doc_id", "left_semi").select("doc_id", "f1", "f2").distinct().join(classes, ["f1", "f2"]).where("doc_id <> rep")
    tried = written(members.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "tried", n_members * 16)
    links = confirm(tried).unionByName(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    links = written(links, "links", (n_members + n_sets) * 16)
    labels = components(links)

    # what the leads have not joined
    named = written(members.join(labels, "id", "left").select("key", "id", "size", "lead", F.coalesce("component", "id").alias("label")), "named", n_members * 40)
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
    apart = written(spread_join(named, written(mixed, "mixed", n_members * 8), ["key"], "n", n_rows), "apart", n_members * 48)
    small, large = apart.where(F.col("size") <= SMALL_BUCKET), apart.where(F.col("size") > SMALL_BUCKET)
    left = small.select("key", F.col("id").alias("a"), F.col("label").alias("la"))
    right = small.select("key", F.col("id").alias("b"), F.col("label").alias("lb"))
    pairs = left.join(right, "key").where("a < b AND la <> lb").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    pairs = written(pairs, "pairs", apart.count() * SMALL_BUCKET * 8)
    links = links.unionByName(confirm(pairs))
    if not large.isEmpty():
        links = links.unionByName(_large(large, full_sets, percent))
    final = components(links)
    known = classes.join(final, classes["rep"] == final["id"], "left").select("f1", "f2", "copies", "rep", F.coalesce("component", "rep").alias("class"))
    told = written(known.where("copies > 1 OR class <> rep").drop("rep"), "told", n_sets * 40)  # any other row is its own component
    forget(members, named, apart, full_sets, reps, buckets, tried, pairs, classes)
    out = spread_join(sets.select("doc_id", "n", "f1", "f2"), told, ["f1", "f2"], "copies", n_sets, "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("class", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _large(large: DataFrame, full_sets: DataFrame, percent: int) -> DataFrame:
    """Links that span the different components of large buckets: overlapping buckets are one group, compared block by block."""
    n = large.count()
    led = written(large.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "led", n * 16)
    groups = components(led)
    of = written(large.select("id", "label").distinct().join(groups, "id").select("id", "label", F.col("component").alias("g")), "grouped", n * 24)
    counts = of.groupBy("g").agg(F.count("*").alias("size"))
    dealt = spread_join(of, written(counts, "sizes", n * 16), ["g"], "size", of.count()).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = written(dealt.select("id", "label", "g", "k", "blocks"), "dealt", n * 32)
    meet = dealt.join(full_sets, "id").select("id", "label", "s", "g", "k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    meet = meet.select("id", "label", "s", "g", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"))

    def run(t: pa.Table) -> pa.Table:
        found = spanning(t.column("id").to_numpy(), t.column("label").to_numpy(), [np.frombuffer(x, np.uint64) for x in t.column("s").to_pylist()], percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    out = written(meet.groupBy("g", "i", "j").applyInArrow(run, "a long, b long"), "links")
    forget(of, dealt, led)
    return out


def op5_neardup(spark, sf_dir):
    """Shingles of 4 words, 80 percent."""
    return near_duplicates(documents(spark, sf_dir), 4, 80)


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
q AS (SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
sh AS (
  SELECT DISTINCT doc_id, hash(g) AS g FROM q WHERE g IS NOT NULL
  UNION SELECT doc_id, hash(array_to_string(ws, ' ')) FROM t WHERE len(ws) BETWEEN 1 AND 3
), n AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS k FROM sh GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.k + y.k - c)
), l AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS far FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.far = l.a),
m AS (SELECT id, min(far) AS component_id FROM r GROUP BY id)
SELECT m.id AS doc_id, coalesce(n.k, 0) AS n_shingles, component_id, m.id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.id
"""
