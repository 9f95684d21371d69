"""Removal of repeated passages by seed and extend.

Texts are sequences of words. Anchors are winnowed: of every ``LENGTH - K + 1`` consecutive k-word hashes the smallest
is kept, so two equal passages of LENGTH words keep the same anchors. Anchors that occur more than once seed the
search. A seed is extended both ways to every window of LENGTH words whose smallest k-word hash it is; the documents of
an anchor are joined by their equal windows, and all but the first (smallest document, then position) are repeats. Runs
of repeated windows merge into maximal repeats, whose words are removed. Windows are equal if two independent
hashes of their words, of 64 and 32 bits, are: among 10^13 windows a false pair has a probability below 10^-3.

No pairs are built: a passage in a third of all documents is one group that is reduced to its first place before the
shuffle, and each document is told only which of its windows come first.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, forget, importable, integer_ids, slices, spread_join, written

LENGTH, K = 20, 8
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)
_FOLD2 = np.uint64(0xA0761D6478BD642F)


class Hashes:
    """64-bit hashes of words, with a bounded memo."""

    CAP = 500_000

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        try:
            return np.array([memo[w] for w in words], np.uint64)
        except KeyError:
            if len(memo) > self.CAP:
                memo.clear()
            h = xxhash.xxh3_64_intdigest
            for w in words:
                if w not in memo:
                    memo[w] = h(w)
            return np.array([memo[w] for w in words], np.uint64)


_WORDS = Hashes()


def windows(h: np.ndarray, k: int, mix: np.uint64 = _MIX, fold: np.uint64 = _FOLD) -> np.ndarray:
    """Hash of each k consecutive words; other odd constants give an independent one."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + m]) * mix
        out ^= out >> np.uint64(29)
        out *= fold
        out ^= out >> np.uint64(32)
    return out


def winnow(h: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k-word hashes, for each window of ``length`` words the place of its anchor: the smallest of its k-word hashes, the last of ties)."""
    g = windows(h, k)
    w = length - k + 1
    if len(g) < w:
        return g, np.zeros(0, np.int64)
    v = sliding_window_view(g, w)[:, ::-1]
    return g, np.arange(len(v)) + (w - 1 - v.argmin(1))


def _anchors(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, at, hs = [], [], []
            for key, text in zip(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "replace").split()
                if len(words) < length:
                    continue
                g, place = winnow(_WORDS(words), length, k)
                p = np.unique(place)
                ids.append(np.full(len(p), key, np.int64))
                at.append(p.astype(np.int32))
                hs.append(g[p].view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(at))], ["anchor", "row", "at"])

    return run


def _seeded(h: np.ndarray, seeds: np.ndarray, length: int, k: int) -> np.ndarray:
    """Starts of the windows whose anchor is at one of the places ``seeds``."""
    place = winnow(h, length, k)[1]
    is_seed = np.zeros(len(h) + 1, bool)
    is_seed[seeds[seeds < len(h)]] = True
    return np.flatnonzero(is_seed[place])


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Mask of the words in the maximal repeats that windows of ``length`` words at ``starts`` merge to."""
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + length] -= 1
    return np.cumsum(edge)[:-1] > 0


def _sha(words: list[bytes]) -> tuple[str, bytes]:
    kept = b" ".join(words)
    return hashlib.sha256(kept).hexdigest(), kept


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _extend(length: int, k: int, with_text: bool):
    """Results of texts without seeds or that are copies; of all others the windows at their seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[] for _ in range(8)]
            for doc_id, row, text, seeds, copy in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), b.column(4).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "replace")
                words, wins, places, gone = data.split(), None, None, 0
                n = len(words)
                if copy and n >= length:
                    words, gone = [], n
                elif seeds.is_valid and n >= length:
                    h = _WORDS(words)
                    at = _seeded(h, seeds.values.to_numpy(), length, k)
                    if len(at):
                        other = (windows(h, length, _MIX2, _FOLD2)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                        wins, places = (windows(h, length)[at].view(np.int64), other), at.astype(np.int64) << 32 | zlib.crc32(data)
                sha, kept = _sha(words) if wins is None else (None, b"")
                for col, x in zip(out, (doc_id, n, gone, sha, kept.decode() if with_text and wins is None else None, row, None if wins is None else text, (wins, places)), strict=True):
                    col.append(x)
            lens = np.array([0] + [0 if w is None else len(p) for w, p in out[7]])
            ends = pa.array(np.cumsum(lens), pa.int32())
            found = [(*w, p) for w, p in out[7] if w is not None] or [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))]
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in zip(*found, strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, kinds, strict=False)), *lists], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "row", "text", "windows", "others", "places"])

    return run


def _remove(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[] for _ in range(4)]
            for text, places, first in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                words, p = text.encode("utf-8", "replace").split(), places.values.to_numpy()
                later = p[~np.isin(p, first.values.to_numpy())] if first.is_valid else p
                mask = covered(len(words), later >> 32, length)
                sha, kept = _sha([words[i] for i in np.flatnonzero(~mask)])
                for col, x in zip(out, (len(words), int(mask.sum()), sha, kept.decode() if with_text else None), strict=True):
                    col.append(x)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by blanks; null without with_text).

    docs: doc_id, an integer, and text; null, empty and blank texts have no words, long ones are taken whole. The first
    place of a passage is in the smallest doc_id (null ones before all, in an order of their texts), then at the earliest
    start, and of rows that share an id in the text with the smaller crc32. Rows that repeat both id and text are one
    place and lose alike. A text equal to one of a smaller id loses all its words, if they are ``length`` or more, and
    takes no further part.
    """
    spark = docs.sparkSession
    importable(spark)
    text = F.coalesce("text", F.lit(""))
    nulls = F.lit(-(2**63)) + F.pmod(F.xxhash64(text, F.lit(2)), F.lit(2**62))  # so that they don't meet in one task
    docs = integer_ids(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), nulls).alias("row"), "text", F.xxhash64(text).alias("d"))
    ids = docs.select("row", "d", F.xxhash64(F.lit(1), text).alias("e"))
    n_rows = docs.count()
    twice = ids.groupBy("d", "e").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    twice = written(twice, "rep-twice")
    copies = spread_join(ids, twice, ["d", "e"], "n", n_rows).where("row > first").groupBy("row").agg(F.collect_set("d").alias("copies"))
    anchors = written(docs.select("row", "text").mapInArrow(_anchors(length, k), "anchor long, row long, at int"), "rep-anchors")
    often = written(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "rep-often")
    seeds = spread_join(anchors, often, ["anchor"], "n", anchors.count()).groupBy("row").agg(F.collect_set("at").alias("seeds"))
    told = written(seeds.join(copies, "row", "full"), "rep-seeds")
    forget(anchors, often, twice)
    is_copy = F.coalesce(F.array_contains("copies", F.col("d")), F.lit(False))
    joined = docs.join(told, "row", "left").select("doc_id", "row", "text", "seeds", is_copy.alias("copy"))
    found = written(joined.mapInArrow(_extend(length, k, with_text), f"{RESULT}, row long, text string, windows array<long>, others array<int>, places array<long>"), "rep-windows")
    forget(told)
    open_ = found.where("text IS NOT NULL")
    each = open_.select("row", F.explode(F.arrays_zip("windows", "others", "places")).alias("w")).select("row", "w.windows", "w.others", "w.places")
    first = each.groupBy("windows", "others").agg(F.min(F.struct("row", "places")).alias("f"))
    firsts = first.groupBy(F.col("f.row").alias("row")).agg(F.collect_list("f.places").alias("first"))
    rest = written(open_.join(firsts, "row", "left").select("doc_id", "text", "places", "first").mapInArrow(_remove(length, with_text), RESULT), "rep-removed")
    return found.where("text IS NULL").select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").unionByName(rest)


def op9_substrings(spark, sf_dir):
    """Windows of 20 words, anchors of 8."""
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM t),
s AS (SELECT doc_id, i, n, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS k FROM w),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(k) ORDER BY doc_id, i) AS r FROM s WHERE i <= n - 19),
c AS (SELECT DISTINCT doc_id, p FROM r, unnest(range(i, i + 20)) AS v(p) WHERE r > 1),
k AS (
  SELECT w.doc_id, count(c.p) AS gone, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE c.p IS NULL), '') AS kept
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id AND c.p = i GROUP BY w.doc_id
)
SELECT t.doc_id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k ON t.doc_id = k.doc_id
"""
