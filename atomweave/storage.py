"""The session's settings and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that the engine's arithmetic needs: wrapping integers and saturating casts instead of errors.

    Also lets workers on this machine import the package; on a cluster it goes along as --py-files.
    """
    spark.conf.set("spark.sql.ansi.enabled", "false")
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is not set and all workers are on this machine."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="atomweave-"))


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/atomweave/facts-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
