"""Shared folders, written intermediate tables, batches and word patterns."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_OWN: dict[str, str] = {}
#: Bytes for a file of a table whose size has a known bound.
FILE_BYTES = 4 << 20
#: While a table is written: shuffle files go when the write has ended, and batches of texts stay small in the workers.
_WRITING = {
    "spark.sql.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Where none is set, a folder of our own, on a local master only: on a cluster executors would write to their own disks.
    """
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="atomweave-")
    return _OWN[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/atomweave/{tag}-{uuid.uuid4().hex}"


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    """The settings of a write; the session's own are back afterwards.

    Only writes may run inside: what is read lazily would lose its shuffle files.
    """
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, tag: str, most: int | None = None) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors, has a known size.

    most: bytes that its rows come to at most, or nearly so. The table then has no more files than that needs: a file costs more than
    a few rows, on a local disk two processes that the executor starts to set rights.
    """
    spark = df.sparkSession
    if most is not None:
        df = df.coalesce(max(1, math.ceil(most / FILE_BYTES)))
    path = fresh_path(spark, tag)
    with _writing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Lets workers on this machine import the package; on a cluster it goes along as --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches (bounded in bytes by Spark) in parts of few rows, so that what is made of each stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def forget(*tables: DataFrame) -> None:
    """Deletes the files of ``written`` tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/atomweave/" in path:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Keys with more than 1 / HEAVY of all rows number fewer than HEAVY, so a table of them has a proven bound.
HEAVY = 20_000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """left.join(right, on, how), ``how`` being inner or left, where few keys may hold most of the rows of left.

    right has one row a key; its column ``weight`` counts the key's rows in left, and ``total`` those of left. The rows
    of heavy keys stay where they are and right's fewer than HEAVY rows for them go to all; the rest is shuffled, in
    which no key has more than 1 / HEAVY of all rows.
    """
    heavy = F.col(weight) * HEAVY > total
    hot = right.where(heavy)
    cols = [*left.columns, *[c for c in right.columns if c not in on]]
    near = left.join(F.broadcast(hot), on).select(*cols)
    far = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(~heavy), on, how).select(*cols)
    return near.unionByName(far)


def integer_ids(docs: DataFrame) -> DataFrame:
    """docs, if doc_id is an integer column: what orders documents or names components needs that."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id must be an integer column, not {kind.simpleString()}")
    return docs


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
