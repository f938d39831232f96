"""An index that grows by batches: partial postings a micro-batch, merged when it is read.

This is the place of partial blocks and their merge: each batch leaves its postings and document lengths under its own
folder, and statistics, which depend on the whole collection, are computed over all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import index as indexing
from tessera.sources import store


def append(documents: DataFrame, path: str, batch: int, stop_words: Sequence[str] | None = None, stem: bool = False) -> None:
    """Write one batch of documents(doc_id, doc_no, text). Doing a batch again replaces it, so a retry leaves no double rows.

    doc_id must be unique over all batches. An empty batch is written as such.
    """
    docs = indexing.analysed(documents, stop_words, stem).persist()  # cleaned once for both tables
    docs.select("doc_id", "doc_no", "doc_len").write.mode("overwrite").parquet(f"{path}/doc_index/batch={batch}")
    indexing.postings_of(docs).write.mode("overwrite").parquet(f"{path}/postings/batch={batch}")
    docs.unpersist()


def start(documents: DataFrame, path: str, checkpoint: str, stop_words: Sequence[str] | None = None, stem: bool = False, available_now: bool = True) -> StreamingQuery:
    """Feed a stream of documents(doc_id, doc_no, text) into the index at ``path``, exactly once by batch number."""
    writer = documents.writeStream.foreachBatch(lambda df, batch: append(df, path, batch, stop_words, stem)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def merged(spark: SparkSession, path: str) -> indexing.Index:
    """The index over all batches so far."""
    doc_index = spark.read.parquet(f"{path}/doc_index").drop("batch")
    postings = spark.read.parquet(f"{path}/postings").drop("batch")
    stats = indexing.collection_stats(doc_index)
    return indexing.Index(doc_index, postings, indexing.lexicon_of(postings, stats), stats)


def compact(spark: SparkSession, path: str, target: str) -> indexing.Index:
    """The batches so far as one stored index at ``target``, sorted by term, in files of ordinary size."""
    return store.save(merged(spark, path), target)
