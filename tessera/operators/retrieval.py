"""Ranked retrieval over an index, for whole batches of queries at once.

A document's score is the sum of its term weights over the distinct query tokens. Conjunctive matching requires every
distinct token, so a token unknown to the lexicon leaves the query without results. Equal scores (to 9 decimals) are
ordered by doc_id. Queries that are null, blank or have no known token give no rows. MaxScore returns exactly the rows of
the exhaustive evaluation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scoring as weights
from tessera.functions import text
from tessera.operators import blocks, bulk
from tessera.operators.index import Index
from tessera.operators.ranking import top_k
from tessera.plans.lineage import cut, release

#: Most documents that are told to the readers of weak terms' lists.
MAX_CANDIDATES = 1_000_000
_SLACK = 1e-9
_TERMS = pa.schema([("number", pa.int64()), ("term", pa.string()), ("idf", pa.float64())])


def parse_queries(topics: DataFrame, stop_words: Sequence[str] | None = None, stem: bool = False) -> DataFrame:
    """query_id, term, n_terms: distinct tokens of each query id; repeated rows of an id add nothing."""
    terms = topics.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("text"), stop_words, stem))).alias("term")).distinct()
    return terms.withColumn("n_terms", F.count(F.lit(1)).over(Window.partitionBy("query_id")))


def _weighted(index: Index, terms: DataFrame, scoring: str, tf_log: str) -> DataFrame:
    """query_id, doc_id, term, n_terms, w: one row for every posting of every query term. doc_len sits in the postings."""
    avgdl = F.lit(index.stats.avgdl)
    w = weights.weight(scoring, F.col("tf"), F.col("idf"), F.col("doc_len"), avgdl, tf_log=tf_log)
    return index.postings.join(terms, "term").select("query_id", "doc_id", "term", "n_terms", w.alias("w"))


def _known(index: Index, queries: DataFrame) -> DataFrame:
    return queries.join(index.lexicon.select("term", "df", "idf", "max_tfidf", "ub_bm25_safe"), "term")


def _ranked(weighted: DataFrame, k: int, conjunctive: bool) -> DataFrame:
    scored = weighted.groupBy("query_id", "doc_id").agg(
        F.sum("w").alias("raw"), F.count(F.lit(1)).alias("matched"), F.max("n_terms").alias("n_terms")
    )
    if conjunctive:
        scored = scored.filter(F.col("matched") == F.col("n_terms"))
    scored = scored.select("query_id", "doc_id", F.round("raw", 9).alias("score"))
    return top_k(scored, "query_id", "score", "doc_id", k).select("query_id", "rank", "doc_id", "score")


def _in_blocks(index: Index, queries: DataFrame, scoring: str, k: int, conjunctive: bool, tf_log: str, prune: bool) -> DataFrame | None:
    """The query set sent to blocks of documents, in shares where it is large; null where its vocabulary is too large to be sent."""
    bound = {"tfidf": "max_tfidf", "bm25": "ub_bm25_safe"}.get(scoring)
    if bound is None:
        raise ValueError(f"unknown scoring: {scoring}")
    # large sets are read several times: their texts are analysed once
    kept = cut(queries.select("query_id", "term"))
    large = kept.count() > blocks.MAX_QUERY_TERMS
    found = bulk.evaluate(index, kept, scoring, k, conjunctive, tf_log) if large else None
    release(kept)
    if large:
        return found
    known = _known(index, queries).select("query_id", "term", "n_terms", "idf", "df", bound).toArrow()
    k = max(k, 1)
    sent, terms = blocks.query_set(known, bound)
    spark = index.postings.sparkSession
    names = F.broadcast(spark.createDataFrame(terms.cast(_TERMS)))
    w = weights.weight(scoring, F.col("tf"), F.col("idf"), F.col("doc_len"), F.lit(index.stats.avgdl), tf_log=tf_log)
    weighted = index.postings.join(names, "term").select("doc_id", "number", w.alias("w"))
    if prune and terms.num_rows and _worth(sent, known):
        sent = replace(sent, least=_reached(weighted, sent, k))
        weighted = _needed(index, weighted, sent)
    found = blocks.evaluate(weighted, sent, k, conjunctive, prune)
    kind = queries.schema["query_id"].dataType
    ranked = top_k(found, "query_id", "score", "doc_id", k)
    return ranked.select(F.col("query_id").cast(kind).alias("query_id"), "rank", "doc_id", "score")


def _reached(weighted: DataFrame, sent: blocks.QuerySet, k: int) -> np.ndarray:
    """For each query a score that k documents are known to reach: the k-th largest weight in the list of one of its terms
    (minus infinity where all lists are shorter). Each task passes on at most k weights of a term."""
    down = Window.partitionBy("number").orderBy(F.col("w").desc())
    kth = weighted.withColumn("r", F.row_number().over(down)).filter(F.col("r") <= k).filter(F.col("r") == k).select("number", "w").toArrow()
    by_term = np.full(int(sent.terms.max()) + 1, -np.inf)
    by_term[kth["number"].to_numpy()] = kth["w"].to_numpy()
    return np.maximum.reduceat(by_term[sent.terms], sent.starts[:-1])


def _worth(sent: blocks.QuerySet, known: pa.Table, least: float = 0.8) -> bool:
    """Whether lists that may turn out weak hold enough of the postings to look at thresholds first. The strongest term of a
    query is never weak; large mixed batches have few others."""
    df = dict(zip(known["term"].to_pylist(), known["df"].to_pylist()))
    by_number = np.array([df[t] for t in known["term"].combine_chunks().dictionary_encode().dictionary.to_pylist()], dtype=np.float64)
    total = by_number.sum()
    by_number[sent.terms[sent.starts[1:] - 1]] = 0
    return bool(by_number.sum() >= least * total)


def _weak(sent: blocks.QuerySet) -> np.ndarray:
    """Numbers of the terms that in every query that has them stay, together with all weaker terms, below what k documents
    reach: a document found only by such terms is in no result."""
    sums = np.cumsum(sent.bounds)
    sums -= np.repeat(np.concatenate([[0.0], sums[sent.starts[1:-1] - 1]]), np.diff(sent.starts))
    strong = sums >= np.repeat(sent.least, np.diff(sent.starts)) - _SLACK
    return np.setdiff1d(sent.terms, sent.terms[strong])


def _needed(index: Index, weighted: DataFrame, sent: blocks.QuerySet) -> DataFrame:
    """The postings to be scored: all of the terms that can lead to a result by themselves, and of the weak terms, whose
    lists are the longest, those in documents that such a term leads to. Which documents these are is told to the readers
    of the weak lists if they are few (a checked bound), so that the rest of these lists is never moved."""
    weak = _weak(sent)
    if not len(weak):
        return weighted
    spark = index.postings.sparkSession
    listed = F.broadcast(spark.createDataFrame(pa.table({"number": weak})))
    strong = weighted.join(listed, "number", "left_anti")
    documents = strong.select("doc_id").distinct().limit(MAX_CANDIDATES + 1).toArrow()
    if documents.num_rows > MAX_CANDIDATES:
        return weighted
    rest = weighted.join(listed, "number", "left_semi").join(F.broadcast(spark.createDataFrame(documents)), "doc_id", "left_semi")
    return strong.unionByName(rest)


def postings_read(index: Index, queries: DataFrame, scoring: str = "bm25", k: int = 10) -> DataFrame:
    """exhaustive, pruned: how many postings go to the scorers, without pruning and with it. One row."""
    bound = {"tfidf": "max_tfidf", "bm25": "ub_bm25_safe"}[scoring]
    sent, terms = blocks.query_set(_known(index, queries).select("query_id", "term", "n_terms", "idf", bound).toArrow(), bound)
    names = F.broadcast(index.postings.sparkSession.createDataFrame(terms.cast(_TERMS)))
    w = weights.weight(scoring, F.col("tf"), F.col("idf"), F.col("doc_len"), F.lit(index.stats.avgdl))
    weighted = index.postings.join(names, "term").select("doc_id", "number", w.alias("w"))
    needed = _needed(index, weighted, replace(sent, least=_reached(weighted, sent, k))) if terms.num_rows else weighted
    count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    return count(weighted, "exhaustive").crossJoin(count(needed, "pruned"))


def daat(index: Index, queries: DataFrame, scoring: str = "bm25", k: int = 10, conjunctive: bool = False, tf_log: str = "log10") -> DataFrame:
    """Exhaustive evaluation, in blocks of documents; where the vocabulary of the queries is too large for that by join,
    aggregation and grouped top-k."""
    found = _in_blocks(index, queries, scoring, k, conjunctive, tf_log, prune=False)
    return daat_join(index, queries, scoring, k, conjunctive, tf_log) if found is None else found


def daat_join(index: Index, queries: DataFrame, scoring: str = "bm25", k: int = 10, conjunctive: bool = False, tf_log: str = "log10") -> DataFrame:
    """Exhaustive evaluation as one join on term, one aggregation on (query, document) and one grouped top-k."""
    return _ranked(_weighted(index, _known(index, queries), scoring, tf_log), k, conjunctive)


def maxscore(index: Index, queries: DataFrame, scoring: str = "bm25", k: int = 10, conjunctive: bool = False, tf_log: str = "log10") -> DataFrame:
    """Upper-bound pruning, in blocks of documents against the running k-th score of each query; for large query
    vocabularies by ``maxscore_join``. Conjunctive matching has nothing to prune this way and is evaluated exhaustively."""
    if conjunctive:
        return daat(index, queries, scoring, k, True, tf_log)
    if tf_log != "log10" and scoring == "bm25":
        raise ValueError("the stored bounds hold for the base 10 logarithm")
    found = _in_blocks(index, queries, scoring, k, False, tf_log, prune=True)
    return maxscore_join(index, queries, scoring, k) if found is None else found


def maxscore_join(index: Index, queries: DataFrame, scoring: str = "bm25", k: int = 10) -> DataFrame:
    """Upper-bound pruning as joins in one plan, without collecting thresholds.

    1. Terms of a query are ordered by their safe bound; running sums of the bounds tell what the weakest terms can add.
    2. The strongest term alone gives each query a lower bound of its k-th score (none when it has fewer than k documents).
    3. Terms whose running sum stays below that threshold are non-essential: a document found only there cannot qualify.
    4. Non-essential postings are read only for documents of the essential ones.
    """
    bound = {"tfidf": "max_tfidf", "bm25": "ub_bm25_safe"}.get(scoring)
    if bound is None:
        raise ValueError(f"unknown scoring: {scoring}")
    order = Window.partitionBy("query_id").orderBy(F.col(bound), "term")
    down = Window.partitionBy("query_id").orderBy(F.col(bound).desc(), F.col("term").desc())
    terms = (
        _known(index, queries)
        .withColumn("cum", F.sum(bound).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("place", F.row_number().over(down))
    )
    probe = _weighted(index, terms.filter(F.col("place") == 1), scoring, "log10")
    kth = top_k(probe, "query_id", "w", "doc_id", k).filter(F.col("rank") == max(k, 1)).select("query_id", F.col("w").alias("theta"))
    split = terms.join(kth, "query_id", "left").withColumn("weak", F.col("cum") < F.coalesce(F.col("theta"), F.lit(0.0)) - _SLACK)
    essential = _weighted(index, split.filter(~F.col("weak")), scoring, "log10")
    candidates = essential.select("query_id", "doc_id").distinct()
    rest = _weighted(index, split.filter("weak"), scoring, "log10").join(candidates, ["query_id", "doc_id"], "left_semi")
    return _ranked(essential.unionByName(rest), k, False)


def search(index: Index, queries: DataFrame, scoring: str = "bm25", algorithm: str = "daat", k: int = 10, conjunctive: bool = False, tf_log: str = "log10") -> DataFrame:
    run = {"daat": daat, "maxscore": maxscore}.get(algorithm)
    if run is None:
        raise ValueError(f"unknown algorithm: {algorithm}")
    return run(index, queries, scoring, k, conjunctive, tf_log)


def next_geq(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """For each (term, target) the first posting with doc_id >= target; no row past the end of the list.

    The last documents of a term's blocks, at most sqrt(df) + 1 numbers, tell which block to open; only that block is
    joined to the target.
    """
    ends = blocks.groupBy("term").agg(F.array_sort(F.collect_list("max_doc_id")).alias("ends"))
    wanted = targets.select("term", "target").distinct().join(ends, "term")
    at = wanted.select("term", "target", F.size(F.filter("ends", lambda e: e < F.col("target"))).alias("block_no"))
    opened = at.join(blocks.select("term", "block_no", "doc_ids", "tfs"), ["term", "block_no"])
    place = F.size(F.filter("doc_ids", lambda d: d < F.col("target")))
    return opened.select("term", "target", F.get("doc_ids", place).alias("doc_id"), F.get("tfs", place).alias("tf"))
