"""The few keys that hold most rows, from mergeable sketches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters of a sketch; an estimate is wrong by at most 3.5 rows in so many, so no key above the bar below is missed.
COUNTERS = 1 << 17
#: A key is heavy from one row in so many on, which also bounds the number of heavy keys.
SHARE = 20_000
#: A key of fewer rows is nowhere a burden.
LEAST = 4096
#: Estimated bytes of the columns in use that a chunk of the input holds at least.
CHUNK_BYTES = 16 << 20
_FAN_IN_BITS = 7
_MOST_CHUNKS = 1 << 21
_WRITTEN_OUT = 1000


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's own estimate. Nothing is planned or run for it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def chunked(df: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """Small partitions joined to chunks, without a shuffle, but never to fewer than there are cores; and a bound on the
    number of chunks."""
    most = min(max(df.sparkSession.sparkContext.defaultParallelism, -(-estimated_bytes(df) // chunk_bytes)), _MOST_CHUNKS)
    return df.coalesce(most), most


@dataclass(frozen=True)
class Heavy:
    """keys: at most ``SHARE`` of them, never null; rows, chunks: of the table as it was read, without null keys; counts: of
    the rows of each key, as the sketch estimates them."""

    keys: list
    rows: int
    chunks: int
    counts: list | None = None

    def split(self, df: DataFrame, key: str, nulls: bool = False) -> tuple[DataFrame | None, DataFrame]:
        """The rows of heavy keys (none where there are none) and all others. ``nulls``: rows without a key are heavy."""
        k = F.col(key)
        if len(self.keys) <= _WRITTEN_OUT:
            if not self.keys and not nulls:
                return None, df
            named = F.coalesce(k.isin(self.keys), F.lit(nulls)) if self.keys else k.isNull()
            return df.filter(named), df.filter(~named)
        listed = df.sparkSession.createDataFrame([(x,) for x in self.keys], df.select(k).schema)
        light = df.join(F.broadcast(listed), key, "left_anti")
        heavy = df.join(F.broadcast(listed), key, "left_semi")
        return (heavy.unionByName(df.filter(k.isNull())), light.filter(k.isNotNull())) if nulls else (heavy, light)


def heavy_keys(df: DataFrame, key: str, least: int = LEAST, share: int = SHARE) -> Heavy:
    """Keys with at least max(``least``, one in ``share``) of the rows, and perhaps a few just below.

    Every chunk of the input makes one sketch of bounded size; sketches are merged at most 128 at a time, in as many rounds
    as that takes, so that no task receives those of all chunks. Only the heavy keys reach the driver.
    """
    rows, most = chunked(df.filter(F.col(key).isNotNull()).select(F.col(key).alias("k")))
    sketch, parts = F.expr(f"approx_top_k_accumulate(k, {COUNTERS})").alias("s"), F.max("p").alias("p")
    merged = [F.expr(f"approx_top_k_combine(s, {COUNTERS})").alias("s"), F.sum("n").alias("n"), parts]
    top = rows.withColumn("p", F.spark_partition_id())
    first, group = True, F.col("p")
    while most > 1 << _FAN_IN_BITS:
        top = top.groupBy(F.shiftright(group, _FAN_IN_BITS).alias("g")).agg(*([sketch, F.count("k").alias("n"), parts] if first else merged))
        first, group, most = False, F.col("g"), most >> _FAN_IN_BITS
    # by a constant, so that an empty table gives no row
    top = top.groupBy(F.lit("all")).agg(*([sketch, F.count("k").alias("n"), parts] if first else merged))
    found = top.select(F.expr(f"approx_top_k_estimate(s, {share})").alias("top"), "n", "p")
    bar = F.greatest(F.lit(least).cast("double"), F.col("n") / share)
    row = found.select(F.filter("top", lambda x: x["count"] >= bar).alias("top"), "n", "p").first()
    return Heavy([x["item"] for x in row["top"]], row["n"], row["p"] + 1, [x["count"] for x in row["top"]]) if row else Heavy([], 0, 1, [])
