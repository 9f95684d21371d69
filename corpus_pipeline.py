"""From raw documents to token ids, in five stages; each works on all its predecessor kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of their input;
further columns go along untouched. Null and letterless texts have no language and leave at the first stage. Texts of
any length are taken whole, an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atomweave.llm import language, mixing, neardup, pieces, pii
from atomweave.llm._common import documents, forget, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter or of no learned language; the profiles come from the input's own labelled rows.

    If no row is labelled, only null and letterless texts go.
    """
    return language.reject(docs, language.learn(docs))


def _packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The given columns and ``row``, a struct of all columns of docs, so that no name clashes."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id.

    Different texts under one doc_id, and texts without one, are documents of their own: the text whose hash is least
    keeps the doc_id, the others are numbered above all ids by their hash. Of rows that repeat doc_id and text the least stays.
    """
    digest, n = F.xxhash64(F.coalesce(docs["text"], F.lit(""))), docs.count()
    keyed = _packed(docs, id=docs["doc_id"].cast("long"), h=digest)
    counts = written(keyed.groupBy("id", "h").agg(F.count("*").alias("n")), "dup-ids", n * 24)
    several = written(counts.where("id IS NOT NULL").groupBy("id").agg(F.min("h").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "dup-several", n * 16)
    own = F.lit(2**62) + F.pmod(F.xxhash64("id", "h"), F.lit(2**61))
    uid = F.when(F.col("id").isNull() | (F.col("first").isNotNull() & (F.col("h") != F.col("first"))), own).otherwise(F.col("id"))
    named = keyed.join(several, "id", "left").select("row", "h", uid.alias("uid"))
    near = neardup.near_duplicates(named.select(F.col("uid").alias("doc_id"), F.col("row.text").alias("text")))
    gone = written(near.where("NOT kept").select(F.col("doc_id").alias("uid")).distinct(), "dup-gone", n * 8)
    kept = named.join(gone, "uid", "left_anti")
    again = written(counts.where("n > 1").select("h").distinct(), "dup-repeated", n * 8)
    once = kept.join(again, "h", "left_anti").select("row")
    repeated = kept.join(again, "h", "left_semi").groupBy("uid", "h").agg(F.min("row").alias("row")).select("row")
    return once.unionByName(repeated).select("row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become their kind in angle brackets; n_chars follows the text."""
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows that repeat doc_id, text and source share what the mix takes of them."""
    keys, size = ("id", "source", "h"), docs.count() * 60
    mixed = mixing.mix(docs).where("size > 0").groupBy(F.col("doc_id").alias("id"), "source", "h").agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("copies"), F.count("*").alias("n"))
    alone = written(mixed.where("copies > 0 AND n = 1"), "mix-alone", size)
    shared = written(mixed.where("copies > 0 AND n > 1"), "mix-shared", size)
    keyed = _packed(docs, id=docs["doc_id"], source=docs["source"], h=mixing.shuffle_hash(docs["doc_id"], docs["text"]))
    same = lambda t: [keyed[k].eqNullSafe(t[k]) for k in keys]
    single = keyed.join(alone, same(alone)).select("row", "copies")
    place = F.row_number().over(Window.partitionBy(keyed["id"], keyed["source"], keyed["h"]).orderBy(keyed["h"]))
    several = keyed.join(shared, same(shared)).select("row", F.expr("copies div n").cast("int").alias("each"), F.expr("copies % n").cast("int").alias("more"), place.alias("k"))
    several = several.select("row", (F.col("each") + (F.col("k") <= F.col("more")).cast("int")).alias("copies")).where("copies > 0")
    return single.unionByName(several).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids in place of the text, with the scores of the next best segmentations."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]
#: Rank-order profiles, sketches and a piece lattice are beyond SQL; the tests hold run() against outcomes worked out by hand
#: on small tables, and its operators, through their own queries, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what goes from one to the next is written to the shared folder."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
