"""Lineage cuts: tables written in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. A temporary folder takes its place only where it is unset and the session
    is local, as in tests; on a cluster executors could not read one, so that is an error."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_folder(spark: SparkSession, name: str = "kept") -> str:
    """A new path in the shared folder; what is written there goes when the application ends, if not before."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place, files = _at(spark, path)
    files.deleteOnExit(place)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df``, written once as Parquet in the shared folder and read back: a lost executor costs no recomputation, and every
    later use reads only the columns it needs. Rows keep neither order nor partitions. ``release`` deletes the files."""
    path = fresh_folder(df.sparkSession)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def release(kept: DataFrame) -> None:
    """Delete what ``cut`` wrote, once nothing reads it any more. Any other frame is left alone."""
    path = kept.__dict__.get("_kept_at")
    if path:
        place, files = _at(kept.sparkSession, path)
        files.delete(place, True)
