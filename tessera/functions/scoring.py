"""Term weights. All in double precision.

Settled points: the logarithm inside the BM25 term frequency is base 10 by default (``tf_log="ln"`` gives the natural
one); BM25 here saturates the damped frequency ``1 + log tf``, not the raw one; unknown scorers raise ``ValueError``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1 = 1.6
B = 0.75


def idf(df: Column, num_docs: Column) -> Column:
    """``log10(N / df)``; null where df is not positive (a term without documents has no weight)."""
    return F.when(df > 0, F.log10(num_docs.cast("double") / df))


def _damped(tf: Column, tf_log: str) -> Column:
    log = {"log10": F.log10, "ln": F.ln}.get(tf_log)
    if log is None:
        raise ValueError(f"unknown logarithm: {tf_log}")
    return F.lit(1.0) + log(tf.cast("double"))


def tfidf(tf: Column, idf_: Column) -> Column:
    """``(1 + log10 tf) * idf``; 0 where tf is null or not positive."""
    return F.when(tf > 0, _damped(tf, "log10") * idf_).otherwise(0.0)


def bm25(tf: Column, idf_: Column, doc_len: Column, avgdl: Column, k1: float = K1, b: float = B, tf_log: str = "log10") -> Column:
    """Damped-frequency BM25; 0 where tf is null or not positive. An empty collection (avgdl 0 or null) gives norm 1-b."""
    damped = _damped(tf, tf_log)
    ratio = F.when(avgdl > 0, doc_len / avgdl).otherwise(0.0)
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.coalesce(ratio, F.lit(0.0)))
    return F.when(tf > 0, idf_ * damped / (damped + norm)).otherwise(0.0)


def raw_bm25_bound(tf: Column, idf_: Column, doc_len: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """The stored per-term figure ``max_bm25``, from raw tf. It is not a safe upper bound and is never used to prune."""
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * doc_len / avgdl)
    return idf_ * tf / (tf + norm)


def weight(scoring: str, tf: Column, idf_: Column, doc_len: Column, avgdl: Column, k1: float = K1, b: float = B, tf_log: str = "log10") -> Column:
    if scoring == "tfidf":
        return tfidf(tf, idf_)
    if scoring == "bm25":
        return bm25(tf, idf_, doc_len, avgdl, k1, b, tf_log)
    raise ValueError(f"unknown scoring: {scoring}")
