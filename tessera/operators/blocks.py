"""Batch evaluation of a stated query set over blocks of documents.

Joining a batch of queries with the postings makes a row of every match, and sorts them all to find ten a query. Here the
queries, whose number of terms is checked against a bound, travel to the documents instead: each partition holds whole
documents, scores a block of them for one query after the other in numpy arrays, and passes on at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most (query, term) rows that are sent to every worker; larger sets are dealt out (see ``bulk``).
MAX_QUERY_TERMS = 100_000
#: Documents a block holds.
BLOCK = 8192
_SLACK = 1e-9


@dataclass(frozen=True)
class QuerySet:
    """Queries as arrays: terms of query i are ``terms[starts[i]:starts[i + 1]]``, weakest upper bound first; ``bounds``
    go with them; ``wanted`` counts the distinct tokens, also those the lexicon lacks; ``least``: a score that k documents
    of the query are known to reach."""

    ids: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    bounds: np.ndarray
    wanted: np.ndarray
    least: np.ndarray | None = None


def query_set(known: pa.Table, bound: str) -> tuple[QuerySet, pa.Table]:
    """The arrays, and (number, term, idf) of the distinct terms, from rows (query_id, term, n_terms, idf, bound)."""
    terms = known["term"].combine_chunks().dictionary_encode()
    number = terms.indices.to_numpy().astype(np.int64)
    query, value, wanted = (known[c].to_numpy() for c in ("query_id", bound, "n_terms"))
    order = np.lexsort((number, value, query))
    ids, starts = np.unique(query[order].astype(np.int64), return_index=True)
    queries = QuerySet(ids, np.append(starts, len(order)), number[order], value[order].astype(np.float64), wanted[order].astype(np.int64)[starts])
    idf = np.zeros(len(terms.dictionary))
    idf[number] = known["idf"].to_numpy()
    return queries, pa.table({"number": np.arange(len(idf)), "term": terms.dictionary, "idf": idf})


class _Best:
    """The k best documents of each query so far, by rounded score and then the smaller document."""

    def __init__(self, queries: int, k: int, least: np.ndarray | None = None) -> None:
        self.k = k
        self.score: list[np.ndarray | None] = [None] * queries
        self.doc: list[np.ndarray | None] = [None] * queries
        self.least = np.full(queries, -np.inf) if least is None else least.copy()

    def add(self, i: int, score: np.ndarray, doc: np.ndarray) -> None:
        if len(score) > self.k:
            kth = np.partition(score, len(score) - self.k)[len(score) - self.k]
            keep = score >= kth - 2 * _SLACK
            score, doc = score[keep], doc[keep]
        score = np.round(score, 9)
        if self.score[i] is not None:
            score, doc = np.concatenate([self.score[i], score]), np.concatenate([self.doc[i], doc])
        order = np.lexsort((doc, -score))[: self.k]
        self.score[i], self.doc[i] = score[order], doc[order]
        if len(order) == self.k:
            self.least[i] = max(self.least[i], score[order[-1]])


def _evaluator(shared, k: int, conjunctive: bool, prune: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: QuerySet = shared.value
        best = _Best(len(queries.ids), k, queries.least if prune else None)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def score(doc: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
            docs, place = np.unique(doc, return_inverse=True)
            order = np.argsort(term, kind="stable")
            term, place, weight = term[order], place[order], weight[order]
            low = np.searchsorted(term, queries.terms, "left")
            high = np.searchsorted(term, queries.terms, "right")
            for i in np.flatnonzero(np.add.reduceat(high - low, queries.starts[:-1])):
                a, b = queries.starts[i], queries.starts[i + 1]
                split = a
                if prune:
                    # terms that even together with all weaker ones stay below the k-th score add no document
                    split = a + int(np.searchsorted(np.cumsum(queries.bounds[a:b]), best.least[i] - _SLACK, "left"))
                    if split == b:
                        continue
                spans = [slice(low[t], high[t]) for t in range(split, b)]
                at = np.concatenate([place[s] for s in spans])
                if not len(at):
                    continue
                total = np.bincount(at, np.concatenate([weight[s] for s in spans]), len(docs))
                matched = np.bincount(at, minlength=len(docs))
                for t in range(split - 1, a - 1, -1):
                    s = slice(low[t], high[t])
                    on = matched[place[s]] > 0
                    total[place[s][on]] += weight[s][on]
                found = np.flatnonzero(matched == queries.wanted[i]) if conjunctive else np.flatnonzero(matched)
                if len(found):
                    best.add(i, total[found], docs[found])

        def flush(final: bool) -> None:
            nonlocal held
            doc, term, weight = (np.concatenate(x) for x in zip(*held))
            # documents are in order; the last may go on in the next batch
            done = len(doc) if final else int(np.searchsorted(doc, doc[-1]))
            if done:
                score(doc[:done], term[:done], weight[:done])
            held = [] if final else [(doc[done:], term[done:], weight[done:])]

        seen, last = 0, None
        for batch in batches:
            doc = batch.column(0).to_numpy()
            if not len(doc):
                continue
            held.append((doc, batch.column(1).to_numpy(), batch.column(2).to_numpy()))
            seen += int((np.diff(doc) != 0).sum()) + (doc[0] != last)
            last = doc[-1]
            if seen > BLOCK:
                flush(False)
                seen = 1
        if held:
            flush(True)
        some = [i for i in range(len(queries.ids)) if best.score[i] is not None]
        for part in (some[i : i + 10_000] for i in range(0, len(some), 10_000)):
            sizes = [len(best.doc[i]) for i in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(queries.ids[part], sizes)), pa.array(np.concatenate([best.doc[i] for i in part])), pa.array(np.concatenate([best.score[i] for i in part]))],
                names=["query_id", "doc_id", "score"],
            )

    return run


def evaluate(weighted: DataFrame, queries: QuerySet, k: int, conjunctive: bool, prune: bool) -> DataFrame:
    """query_id, doc_id, score: the k best of each query in each partition, from weighted(doc_id, term number, weight).

    The number of partitions is left to adaptive execution, which sizes them by what was shuffled (64 MB by default, millions
    of postings), so the lists of k that leave them are a few percent of that."""
    shared = weighted.sparkSession.sparkContext.broadcast(queries)
    rows = weighted.select("doc_id", "number", "w").repartition("doc_id").sortWithinPartitions("doc_id")
    return rows.mapInArrow(_evaluator(shared, k, conjunctive, prune and not conjunctive), "query_id bigint, doc_id bigint, score double").select(
        F.col("query_id"), "doc_id", "score"
    )
