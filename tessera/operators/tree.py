"""Per-key distinct counts where a few keys hold most rows: multi-level tree aggregation.

Input is read in chunks of fixed size. The keys that a sketch names as heavy take the tree: each chunk combines its own rows
of them into set states before anything moves, and states are merged in rounds that join at most ``fan_in`` neighbouring
chunks each, until one is left. A state is one 64-bit word: the values of a key within an aligned range of 64, so it has a
fixed size however many rows the key has, and plain hash aggregation combines it. All other keys leave the tree: none of
them has more than one row in 20,000, and their rows meet in one shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.heavy import LEAST, SHARE, chunked, heavy_keys

def tree_count_distinct(df: DataFrame, key: str, value: str, fan_in: int = 8, name: str = "n_distinct", least: int = LEAST, share: int = SHARE) -> DataFrame:
    """(key, n_distinct): the exact number of distinct non-null integers ``value`` of each key.

    A key whose values are all null gets 0. A null key is a key like any other and takes the tree. Repeated rows, any
    number of them, change nothing. An empty table gives no rows. The number of chunks only decides how many rounds there
    are: the last round merges by key and range alone, so a wrong number cannot change a count.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("long").alias("v"))
    heavy = heavy_keys(rows, "k", least, share)
    tree, light = heavy.split(chunked(rows)[0], "k", nulls=True)
    word = F.shiftright("v", 6).alias("w")
    state = F.bit_or(F.expr("shiftleft(1L, cast(v & 63 AS int))")).alias("s")
    ones = F.sum(F.coalesce(F.bit_count("s"), F.lit(0))).cast("long").alias(name)
    # no key here is a burden: its rows meet once, and neither aggregation moves them again
    left = light.repartition("k").groupBy("k", word).agg(state).groupBy("k").agg(ones)
    # the map side of the first aggregation is the chunk's own combine
    states, merged = tree.withColumn("chunk", F.spark_partition_id()), state
    for _ in range(math.ceil(round(math.log(max(2, heavy.chunks), fan_in), 9)) - 1):
        states = states.groupBy("k", word if merged is state else F.col("w"), F.floor(F.col("chunk") / F.lit(fan_in)).alias("chunk")).agg(merged)
        merged = F.bit_or("s").alias("s")
    whole = states.groupBy("k", word if merged is state else F.col("w")).agg(merged).groupBy("k").agg(ones)
    return left.unionByName(whole).withColumnRenamed("k", key)


def term_documents(postings: DataFrame, lexicon: DataFrame, fan_in: int = 8) -> DataFrame:
    """term, n_docs, lexicon_df: distinct documents of each term beside the recorded df, over all terms of either side.

    Terms lose trailing blanks; null terms are left aside; a null df and a missing side count as 0. The recorded df of a
    term is the sum over its distinct (spimi_block, term, df) rows.
    """
    term = F.rtrim("term").alias("term")
    counted = tree_count_distinct(postings.filter(F.col("term").isNotNull()).select(term, "doc_id"), "term", "doc_id", fan_in, "n_docs")
    recorded = (
        lexicon.filter(F.col("term").isNotNull()).select("spimi_block", term, "df").distinct()
        .groupBy("term").agg(F.sum(F.coalesce("df", F.lit(0))).cast("long").alias("lexicon_df"))
    )
    return counted.join(recorded, "term", "full_outer").select(
        "term", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("lexicon_df", F.lit(0)).alias("lexicon_df")
    )
