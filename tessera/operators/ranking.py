"""Ranks that survive groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.lineage import cut


def chunked_row_number(df: DataFrame, key: str, order: str, chunk: Column, name: str = "rank", total: str | None = None, few: bool = False) -> DataFrame:
    """0-based position of each row within ``key`` in ascending ``order``, without one task ever holding a whole key.

    Rows are numbered within (key, chunk); the chunk counts, one small row each, are summed up along the key to give every
    chunk its start. The positions follow ``order`` where ``chunk`` does not decrease along it; with any other chunks they
    are still 0, 1, 2 ... without gaps. ``total`` names a column for the number of rows of the key. A null key is a key
    like any other. ``few``: the caller vouches that keys times chunks are few, so that their counts may be broadcast.
    """
    # key and chunk as one value that is never null: window and join ask for the same partitions, so rows move once
    parts = df.withColumn("_at", F.struct(F.col(key).alias("key"), chunk.alias("chunk")))
    along = Window.partitionBy("_at.key")
    starts = parts.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(along.orderBy("_at.chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.withColumn("_total", F.sum("_n").over(along)).drop("_n")
    numbered = parts.withColumn("_within", F.row_number().over(Window.partitionBy("_at").orderBy(order)) - 1)
    joined = numbered.join(F.broadcast(starts) if few else starts, "_at").withColumn(name, F.col("_start") + F.col("_within"))
    return (joined.withColumn(total, F.col("_total")) if total else joined).drop("_at", "_within", "_start", "_total")


def _placed(rows: DataFrame, name: str) -> DataFrame:
    """Dense 0-based ``name`` along ``_part``, ``_split`` and, within these, ``_row``, which counts without gaps."""
    where = ["_part", "_split"]
    counts = rows.groupBy(*where).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_least"))
    # one row an input split, however many rows of data these have
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy(*where).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.join(F.broadcast(starts.drop("_n")), where)
    return placed.withColumn(name, (F.col("_start") + F.col("_row") - F.col("_least")).cast("long")).drop(*where, "_row", "_least", "_start")


def dense_ids(df: DataFrame, order: list[str] | None = None, name: str = "doc_id") -> DataFrame:
    """Dense 0-based ids along ``order``, or in the order of the input partitions, without a global window.

    Rows are range-sorted once (if at all) and kept in the shared folder, so that their places cannot shift between the two
    passes; the row counts of the partitions, one row each, give every partition its start.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    # monotonically_increasing_id: the partition above 33 bits, the row within it below
    row = F.monotonically_increasing_id()
    kept = cut(rows.withColumn("_row", row)).withColumn("_part", F.shiftright("_row", 33)).withColumn("_split", F.lit(0))
    return _placed(kept, name)


def ids_by_file(rows: DataFrame, name: str = "doc_id") -> DataFrame:
    """Dense 0-based ids in the order of the lines of files: by file name, place in the file, line. ``rows`` are straight
    from a file scan, with narrow transformations only; nothing is shuffled or sorted, the files are read twice."""
    placed = rows.select("*", F.col("_metadata.file_path").alias("_part"), F.col("_metadata.file_block_start").alias("_split"))
    return _placed(placed.withColumn("_row", F.monotonically_increasing_id()), name)


def top_k(df: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group with ranks from 1: score descending, then the smaller ``tie``. k is at least 1."""
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(k, 1))
