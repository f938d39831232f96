"""Problem 1: frequency of every distinct term, by heavy-light aggregation.

Mergeable sketches name the terms that hold at least one in 20,000 of the rows. Their list, bounded whatever the data, goes
to every reader, written into the plan or broadcast; their rows are counted where they are read, into exact local counters: arrays of 64 documents, one bit each,
beside the sum of tf. Only these move. The rows of all other terms, none of which is large, are shuffled by term once.
Both count tables are united. Being named or not changes where a term is counted, never its count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.heavy import LEAST, SHARE, heavy_keys


def term_frequencies(postings: DataFrame, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """term, df, cf of every term of postings(term, doc_id, tf).

    df counts distinct non-null doc_id, whatever their tf; cf sums tf over all rows as delivered (repeated rows repeat
    their tf, null counts 0). Trailing blanks of terms are dropped first; null terms are left aside; the empty term
    is a term. An empty table gives no rows. ``least``, ``share``: rows and share of the rows from which a term is heavy.
    """
    rows = postings.select(F.rtrim("term").alias("term"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("tf", F.lit(0)).cast("long").alias("tf"))
    rows = rows.filter(F.col("term").isNotNull())
    heavy, light = heavy_keys(rows, "term", least, share).split(rows, "term")
    word = F.shiftright("doc_id", 6).alias("word")
    counters = [F.bit_or(F.expr("shiftleft(1L, cast(doc_id & 63 AS int))")).alias("docs"), F.sum("tf").alias("tf")]
    whole = [F.sum(F.coalesce(F.bit_count("docs"), F.lit(0))).cast("long").alias("df"), F.sum("tf").alias("cf")]
    # partitioned by term: neither aggregation moves a row again
    counts = light.repartition("term").groupBy("term", word).agg(*counters).groupBy("term").agg(*whole)
    if heavy is None:
        return counts
    # the map side of the first aggregation fills the local counters; ranges of one term spread over the reducers
    return heavy.groupBy("term", word).agg(*counters).groupBy("term").agg(*whole).unionByName(counts)


def marked(frequencies: DataFrame, doc_index: DataFrame, rare_below: int = 3, common_percent: int = 40) -> DataFrame:
    """Adds ``mark``: ``rare`` below ``rare_below`` documents, ``common`` above ``common_percent`` of the collection's
    distinct doc_id, else null. In a collection so small that both hold, rare wins."""
    docs = doc_index.agg(F.count_distinct("doc_id").alias("n")).first()["n"]
    common = F.col("df") * 100 > F.lit(docs * common_percent)
    return frequencies.withColumn("mark", F.when(F.col("df") < rare_below, "rare").when(common, "common"))
