"""Effectiveness of ranked results against judgments, for all queries in one plan.

Results are (query_id, rank, doc_id); judgments (query_id, doc_id, relevance), one per pair. Unjudged documents count as
relevance 0. Only queries with judgments are evaluated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unique_judgments(qrels: DataFrame, order: list[str]) -> DataFrame:
    """One judgment a (query, document): of repeated ones the last in ``order``. Null relevance counts as 0."""
    last = F.max_by(F.coalesce("relevance", F.lit(0)), F.struct(*order))
    return qrels.groupBy("query_id", "doc_id").agg(last.alias("relevance"))


def judged_results(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """query_id, rank, doc_id, relevance for queries that have judgments."""
    known = results.select("query_id", "rank", "doc_id").join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    return known.join(qrels, ["query_id", "doc_id"], "left").select("query_id", "rank", "doc_id", F.coalesce("relevance", F.lit(0)).alias("relevance"))


def metrics(results: DataFrame, qrels: DataFrame, k: int = 10, base: float = 10.0, variant: str = "judged", dcg: str = "rank") -> DataFrame:
    """precision, recall, average precision and DCG at k for each judged query (0 where nothing was returned).

    variant "judged": precision divides by min(k, number of judgments) and average precision sums the precision at
    relevant ranks; "plain": precision divides by k and average precision sums it over all ranks. Both divide average
    precision by the number of results. dcg "rank" discounts by max(1, log_base(rank)), "constant" by max(1, log_base(k)).
    """
    if variant not in ("judged", "plain") or dcg not in ("rank", "constant"):
        raise ValueError(f"unknown variant: {variant}, {dcg}")
    totals = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("judged"), F.count(F.when(F.col("relevance") > 0, 1)).alias("relevant"))
    seen = judged_results(results, qrels).filter(F.col("rank") <= k)
    hit = (F.col("relevance") > 0).cast("int")
    along = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    at = seen.withColumn("hit", hit).withColumn("p_at", F.sum("hit").over(along) / F.col("rank"))
    discount = F.greatest(F.lit(1.0), F.ln(F.col("rank") if dcg == "rank" else F.lit(k)) / F.ln(F.lit(base)))
    p_sum = F.sum(F.when(F.col("hit") == 1, F.col("p_at")).otherwise(0.0) if variant == "judged" else F.col("p_at"))
    per_query = at.groupBy("query_id").agg(
        F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("returned"), p_sum.alias("p_sum"), F.sum(F.col("relevance") / discount).alias("dcg")
    )
    hits = F.coalesce("hits", F.lit(0))
    shown = F.least(F.lit(k), F.col("judged")) if variant == "judged" else F.lit(k)
    return totals.join(per_query, "query_id", "left").select(
        "query_id",
        (hits / shown).alias("precision"),
        F.when(F.col("relevant") > 0, hits / F.col("relevant")).otherwise(0.0).alias("recall"),
        F.coalesce(F.col("p_sum") / F.col("returned"), F.lit(0.0)).alias("average_precision"),
        F.coalesce("dcg", F.lit(0.0)).alias("dcg"),
    )


def summary(per_query: DataFrame) -> DataFrame:
    """Means over the evaluated queries (the mean of average precision is MAP) and the deviation of DCG."""
    return per_query.agg(
        F.count(F.lit(1)).alias("queries"), F.avg("average_precision").alias("map"), F.avg("precision").alias("mean_precision"),
        F.avg("recall").alias("mean_recall"), F.avg("dcg").alias("mean_dcg"), F.stddev_pop("dcg").alias("std_dcg"),
    )
