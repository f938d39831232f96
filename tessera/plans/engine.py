"""The search engine facade: build or load an index, answer one query or a batch."""

from __future__ import annotations

import statistics
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import index as indexing
from tessera.operators import retrieval
from tessera.sources import store


@dataclass
class SearchEngine:
    """An index with the analysis it was built with. ``cache`` keeps postings and lexicon in executor memory until ``close``
    (or the end of a ``with`` block); results never depend on it."""

    index: indexing.Index
    stop_words: Sequence[str] | None = None
    stem: bool = False

    @classmethod
    def build(cls, documents: DataFrame, stop_words: Sequence[str] | None = None, stem: bool = False, path: str | None = None, blocks: bool = False) -> SearchEngine:
        built = indexing.build(documents, stop_words, stem)
        return cls(store.save(built, path, blocks) if path else built, stop_words, stem)

    @classmethod
    def load(cls, spark: SparkSession, path: str, stop_words: Sequence[str] | None = None, stem: bool = False, cache: bool = False) -> SearchEngine:
        engine = cls(store.load(spark, path), stop_words, stem)
        if cache:
            engine.index.postings.persist()
            engine.index.lexicon.persist()
        return engine

    def close(self) -> None:
        self.index.postings.unpersist()
        self.index.lexicon.unpersist()

    def __enter__(self) -> SearchEngine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def latency(self, queries: Sequence[str], **how) -> tuple[float, float]:
        """Mean and standard deviation of the seconds that each of the queries takes by itself."""
        took = []
        for query in queries:
            began = time.perf_counter()
            self.search(query, **how).collect()
            took.append(time.perf_counter() - began)
        return (statistics.fmean(took), statistics.pstdev(took)) if took else (0.0, 0.0)

    def search(self, query: str, scoring: str = "bm25", algorithm: str = "daat", k: int = 10, conjunctive: bool = False) -> DataFrame:
        topics = self.index.postings.sparkSession.createDataFrame([(0, query)], "query_id int, text string")
        return self.search_batch(topics, scoring, algorithm, k, conjunctive).drop("query_id")

    def search_batch(self, topics: DataFrame, scoring: str = "bm25", algorithm: str = "daat", k: int = 10, conjunctive: bool = False) -> DataFrame:
        """query_id, rank, doc_id, doc_no, score for every topic(query_id, text) in one plan."""
        queries = retrieval.parse_queries(topics, self.stop_words, self.stem)
        found = retrieval.search(self.index, queries, scoring, algorithm, k, conjunctive)
        return found.join(self.index.doc_index.select("doc_id", "doc_no"), "doc_id", "left").select("query_id", "rank", "doc_id", "doc_no", F.col("score"))
