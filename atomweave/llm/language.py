"""Language identification by rank-order profiles.

A profile is a language's most frequent character 1- to 3-grams in order of frequency. A text's own most frequent
n-grams are compared with each profile by out-of-place distance: the sum, over the text's n-grams, of how far each
stands from its place in the profile, or the greatest distance where the profile lacks it. The nearest language wins.

N-grams are taken over lower-cased letters, with one blank for each run of anything else; those with two blanks do not
count. They are packed into 63 bits, so counting is sorting.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ._common import documents, importable, slices

PROFILE = 400
#: Random letters score up to 0.21, running text of a learned language from 0.45 up, if there are enough letters.
LEAST_SCORE, ENOUGH_GRAMS = 0.3, 300
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def grams(text: str) -> np.ndarray:
    """Packed 1- to 3-grams of a text, repeats included; empty if it has no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of each run of others, the first stays as a blank
    c = np.where(letter, c, 32)[keep].astype(np.int64)
    c = np.concatenate([[32], c, [32]]) if c[-1] != 32 else np.concatenate([[32], c])
    blank = c == 32
    two = c[:-1] << 21 | c[1:]
    three = two[:-1] << 21 | c[2:]
    return np.concatenate([c[~blank], two, three])


def ranked(text: str, size: int) -> np.ndarray:
    """The most frequent n-grams of a text, most frequent first, ties by packed value."""
    return _top(grams(text), size)


def _top(g: np.ndarray, size: int) -> np.ndarray:
    if not len(g):
        return g
    u, n = np.unique(g, return_counts=True)
    if len(u) > size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        u, n = u[n >= least], n[n >= least]
    return u[np.lexsort((u, -n))][:size]


class Model:
    """Profiles: language -> packed n-grams by rank."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE) -> None:
        self.langs, self.size = sorted(profiles), size
        every = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        place = np.full((len(self.langs), len(every) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            place[i, np.searchsorted(every, profiles[lang])] = np.arange(len(profiles[lang]))
        self.every, self.place = every, place

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): score is 1 less the mean distance over the greatest one; `und`, 0 without letters or profiles."""
        return self.nearest(grams(text or ""))

    def nearest(self, g: np.ndarray) -> tuple[str, float]:
        """``predict`` for the n-grams of a text."""
        r = _top(g, self.size)
        if not len(r) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.every, r)
        at[at == len(self.every)] = 0
        at = np.where(self.every[at] == r, at, len(self.every))
        place = self.place[:, at]
        far = np.where(place < 0, self.size, np.minimum(np.abs(place - np.arange(len(r))), self.size)).sum(1)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (self.size * len(r)))


def held_out(doc_id) -> F.Column:
    """Documents that are not learned from: crc32 of the id as text, mod 4, is 2. Not so for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, size: int = PROFILE) -> Model:
    """Profiles from all rows of docs (text, lang) with a language, whole texts; the driver gets size n-grams a language."""
    importable(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def add(lang: str, u: np.ndarray, n: np.ndarray) -> None:
            held.setdefault(lang, []).append((u, n))

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            u, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return u, np.bincount(inv, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64)

        for b in slices(batches):
            texts: dict[str, list[str]] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text or "")
            for lang, xs in texts.items():
                for g in map(grams, xs):
                    if len(g):
                        add(lang, *np.unique(g, return_counts=True))
                held[lang] = [merged(held[lang])] if lang in held else []
                if not held[lang]:
                    del held[lang]
                elif len(held[lang][0][0]) > 1_000_000:  # a part's tables stay bounded
                    yield _counts(lang, *held.pop(lang)[0])
        for lang, parts in held.items():
            yield _counts(lang, *merged(parts))

    known = docs.where(F.col("lang").isNotNull()).select("text", "lang")
    counts = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return Model(profiles, size)


def _counts(lang: str, u: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score, one row for each.

    Null, empty and letterless texts are `und`, as is every text if nothing was learned. Languages at the same distance
    go by name. Whole texts count, however long; repeated rows are alike.
    """
    importable(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [model.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(rows, StructType([docs.schema["doc_id"], *StructType.fromDDL("lang_pred string, score double").fields]))


def reject(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """docs without the rows whose text has no letter, or is of no learned language; all columns stay as they are.

    Of no learned language is a text of at least ENOUGH_GRAMS n-grams (about 100 letters) that scores below ``least``.
    Shorter texts say too little, and if nothing was learned only the letter counts.
    """
    importable(docs.sparkSession)
    at = docs.columns.index("text")

    def keep(text: str | None) -> bool:
        g = grams(text or "")
        return len(g) > 0 and (len(g) < ENOUGH_GRAMS or not model.langs or model.nearest(g)[1] >= least)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array([keep(t) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def op2_language(spark, sf_dir):
    """Learned from all documents but the held-out quarter."""
    docs = documents(spark, sf_dir)
    model = learn(docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
