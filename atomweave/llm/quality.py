"""Quality rules with tokeniser fertility.

Base rules count words, symbols, repeated lines and repeated 5-word windows. The method adds what a public vocabulary
says of a text's words: characters per token, share of byte-fallback tokens and entropy of the token distribution. A
text whose figures leave the band of its language (its main script, if no language is given) is rejected.

Bands come from all documents that pass the base rules: for each language and length class (whole part of log2 of the
tokens, since entropy grows with length) the quartiles of each figure, widened on either side by SPREAD times that
side's distance from the median. Quartiles are read from counts of rounded figures, which merge before they are
shuffled and come out alike on every run. Classes of fewer than LEAST_DOCS documents use the fixed bands of the script.
The bands hold as long as junk that passes the base rules stays below a quarter of a class.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ._common import documents, importable, slices, written

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
WINDOW = 5


class Band(NamedTuple):
    """Limits of a script: characters per token, byte-fallback share, entropy in bits per log2 of the distinct tokens possible."""

    least_chars: float
    most_chars: float
    most_fallback: float
    least_entropy: float


#: Fixed bands by script. Entropy is divided by log2(min(tokens, 1024)), so short and long texts compare.
BANDS = {
    "LATIN": Band(1.1, 8.0, 0.10, 0.20),
    "CYRILLIC": Band(1.0, 8.0, 0.10, 0.30),
    "GREEK": Band(0.8, 6.0, 0.20, 0.30),
    "CJK": Band(0.35, 4.0, 0.70, 0.30),
    "HIRAGANA": Band(0.5, 4.0, 0.50, 0.30),
    "KATAKANA": Band(0.5, 4.0, 0.50, 0.30),
    "HANGUL": Band(0.35, 4.0, 0.80, 0.30),
}
OTHER = Band(0.2, 12.0, 0.95, 0.20)
#: Texts with fewer tokens say too little: no band is applied.
LEAST_TOKENS = 20
SPREAD, LEAST_DOCS = 6.0, 30
#: Figures, the unit they are rounded to for counting, and the least distance of a quartile from the median: a share of it, or as it is.
FIGURES = (("chars_per_token", 0.01, 0.005, 0.0), ("token_entropy", 0.01, 0.005, 0.0), ("fallback_share", 0.001, 0.0, 0.02))


def script(word: str) -> str:
    """Script of the first letter, by its Unicode name; '' without letters."""
    for c in word:
        if c.isalpha():
            return "LATIN" if c < "ɐ" else unicodedata.name(c, "").partition(" ")[0]
    return ""


class Fertility:
    """Token ids, number and script of a word, by a sentencepiece model with byte fallback; a bounded memo."""

    CAP = 400_000

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        self.memo: dict[bytes, tuple[bytes, int]] = {}
        self.scripts: dict[str, int] = {"": 0}

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of all words, and for each word its number (equal words, equal numbers) and script."""
        memo = self.memo
        new = [w for w in set(words) if w not in memo]
        if new:
            if len(memo) + len(new) > self.CAP:
                memo.clear()
                new = list(set(words))
            for s in range(0, len(new), 4096):
                part = [w.decode() for w in new[s : s + 4096]]
                for w, x, ids in zip(new[s : s + 4096], part, self.sp.encode(part, num_threads=1), strict=True):
                    memo[w] = (array("i", ids).tobytes(), len(memo) << 8 | self.scripts.setdefault(script(x), len(self.scripts)))
        got = [memo[w] for w in words]
        both = np.array([g[1] for g in got], np.int64)
        return np.frombuffer(b"".join([g[0] for g in got]), np.int32), both >> 8, both & 255

    def figures(self, ids: np.ndarray, scripts: np.ndarray) -> tuple[int, int, float, str]:
        """(tokens, byte tokens, entropy in bits, main script) of a text's words."""
        if not len(scripts):
            return 0, 0, 0.0, ""
        share = np.unique(ids, return_counts=True)[1] / max(1, len(ids))
        tally = np.bincount(scripts, minlength=len(self.scripts))
        tally[0] = 0
        main = list(self.scripts)[int(tally.argmax())] if tally.any() else ""
        return len(ids), int(self.byte[ids].sum()), float(-(share * np.log2(share)).sum()), main


def _fixed() -> Column:
    """True where the figures lie in the fixed band of the script."""
    out = None
    for name, band in BANDS.items():
        out = (F.when if out is None else out.when)(F.col("script") == name, _inside(band))
    return out.otherwise(_inside(OTHER))


def _inside(b: Band) -> Column:
    room = F.log2(F.least(F.col("n_tokens"), F.lit(1024)))
    return F.col("chars_per_token").between(b.least_chars, b.most_chars) & (F.col("fallback_share") <= b.most_fallback) & (F.col("token_entropy") >= b.least_entropy * room)


def bands(figures: DataFrame, spread: float = SPREAD, least_docs: int = LEAST_DOCS) -> DataFrame:
    """band, length, and least and most of each figure, for classes of at least ``least_docs`` of the rows of ``figures``."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.round(F.col(n) / unit).cast("long").alias("v")) for i, (n, unit, _, _) in enumerate(FIGURES)]))
    counts = figures.select("band", "length", each.alias("x")).groupBy("band", "length", "x.i", "x.v").agg(F.count("*").alias("n"))
    key = Window.partitionBy("band", "length", "i")
    upto = counts.withColumn("upto", F.sum("n").over(key.orderBy("v"))).withColumn("all", F.sum("n").over(key)).where(F.col("all") >= least_docs)
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("v")))
    quartiles = upto.groupBy("band", "length", "i").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    limits = []
    for i, (name, unit, share, least) in enumerate(FIGURES):
        narrow = F.greatest(F.col("q2") * share, F.lit(least / unit))
        low = (F.col("q2") - spread * F.greatest(F.col("q2") - F.col("q1"), narrow)) * unit
        high = (F.col("q2") + spread * F.greatest(F.col("q3") - F.col("q2"), narrow)) * unit
        limits += [F.max(F.when(F.col("i") == i, x)).alias(f"{side}_{name}") for side, x in (("least", low), ("most", high))]
    return quartiles.groupBy("band", "length").agg(*limits)


def repeated_words(a: np.ndarray) -> int:
    """Words, given as numbers, that are covered by 5-word windows which occur twice or more."""
    m = len(a) - WINDOW + 1
    if m < 2:
        return 0
    mixed = np.zeros(m, np.uint64)
    for k in range(WINDOW):
        mixed = (mixed ^ a[k : k + m].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():  # equal windows mix alike, so none is equal
        return 0
    a = np.unique(a, return_inverse=True)[1]
    rank, top = a, np.int64(len(a) + 1)
    for step, width in ((1, 2), (2, 4), (0, 5)):  # ranks of windows of 2, 4 and then 5 words; exact, no hashing
        n = len(a) - width + 1
        rank = np.unique(rank[:n] * top + (a[4:] if width == 5 else rank[step : step + n]), return_inverse=True)[1]
    at = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edge = np.zeros(len(a) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return len(lines) - len(set(lines))


_MODELS: dict[str, Fertility] = {}
MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, fallback_share double, token_entropy double, script string, base_failed boolean"


def measured(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, lang and MEASURED for each row of docs (doc_id, lang, text); a null text has no words and fails the base rules."""
    importable(docs.sparkSession)
    names = [x.split()[0] for x in MEASURED.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _MODELS:
            _MODELS[vocabulary] = Fertility(vocabulary)
        model = _MODELS[vocabulary]
        for b in slices(batches):
            out: list[list] = [[] for _ in names]
            for t in b.column(2).to_pylist():
                text = t or ""
                words = text.encode("utf-8", "replace").split()
                ids, numbers, scripts = model.words(words)
                chars, repeats = len(text) - sum(map(text.count, BLANK)), repeated_words(numbers)
                tokens, fallback, entropy, main = model.figures(ids, scripts)
                failed = len(words) < 10 or 100 * repeats > 20 * len(words)
                for col, x in zip(out, (len(words), chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats, tokens, chars / tokens if tokens else 0.0, fallback / tokens if tokens else 0.0, entropy, main, failed), strict=True):
                    col.append(x)
            kinds = [pa.int64()] * 6 + [pa.float64()] * 3 + [pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "lang", *names])

    schema = StructType([docs.schema["doc_id"], docs.schema["lang"], *StructType.fromDDL(MEASURED).fields])
    return docs.select("doc_id", "lang", "text").mapInArrow(rows, schema)


def quality(docs: DataFrame, vocabulary: str, spread: float = SPREAD, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, MEASURED and kept, one row for each row of docs (doc_id, text; lang, where there is one, names the band).

    Null, empty and blank texts have no words and fail the base rules. Rows that repeat are judged alike, each counts for
    the bands. Texts of fewer than LEAST_TOKENS tokens are kept if the base rules keep them. A word of any length is
    tokenised whole.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    seen = written(measured(docs.select("doc_id", lang.alias("lang"), "text"), vocabulary), "quality-figures")
    classed = seen.withColumn("band", F.coalesce("lang", "script")).withColumn("length", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int"))
    limits = written(bands(classed.where((F.col("n_tokens") >= LEAST_TOKENS) & ~F.col("base_failed")), spread, least_docs), "quality-bands")
    fits = F.lit(True)
    for name, *_ in FIGURES:
        fits &= F.col(name).between(F.col(f"least_{name}"), F.col(f"most_{name}"))
    verdict = ~F.col("base_failed") & ((F.col("n_tokens") < LEAST_TOKENS) | F.coalesce(fits, _fixed()))
    names = [x.split()[0] for x in MEASURED.split(", ")]
    return classed.join(limits, ["band", "length"], "left").select("doc_id", *names, verdict.alias("kept"))


def op8_quality(spark, sf_dir):
    """piece_bpe_32k.model, bands of all documents by lang."""
    import public_tokenizers

    return quality(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
