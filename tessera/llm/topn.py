"""Problem 2: the N best items of every group, by a hot-cold split on exact group counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A group is hot from this many rows on, and there are at most MAX_HOT hot groups (the bar rises with the data).
HOT_ROWS = 50_000
MAX_HOT = 512


def best_scores(items: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """One row for each (group, item) with its highest score. Rows with a null group, a null item, or a null or NaN
    score do not count. Partial aggregation before the shuffle makes repeated rows cheap."""
    usable = F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)
    rows = items.filter(usable).select(F.col(group), F.col(item), F.col(score).cast("double").alias(score))
    return rows.groupBy(group, item).agg(F.max(score).alias(score))


def top_n(items: DataFrame, group: str, item: str, score: str, n: int, hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT) -> DataFrame:
    """(group, item, score, rank) with the n best items of each group: higher score first, then the smaller item.

    An item counts once, with its highest score; see ``best_scores`` for rows that do not count. Groups without usable
    rows give none. Groups with more than ``hot_rows`` rows (at most ``max_hot`` of them, by the pigeonhole principle on
    the total) are sorted by range, salted by score and item, so that a group of any size spreads over many tasks; each
    task passes on at most n rows a group. All other groups take an ordinary window.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    usable = F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)
    counts = items.filter(usable).groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("t")).first()["t"]
    bar = max(hot_rows, total // max_hot)
    hot_groups = [r[0] for r in counts.filter(F.col("rows") > bar).select(group).collect()]  # at most max_hot
    order = [F.col(score).desc(), F.col(item).asc()]

    def ranked(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)

    cold = items
    out = None
    if hot_groups:
        names = F.broadcast(items.sparkSession.createDataFrame([(g,) for g in hot_groups], items.select(group).schema))
        cold = items.join(names, group, "left_anti")
        hot = best_scores(items.join(names, group, "left_semi"), group, item, score)
        spread = hot.repartitionByRange(F.col(group), *order).withColumn("_range", F.spark_partition_id())
        out = ranked(ranked(spread, group, "_range").drop("_range", "rank"), group)
    light = ranked(best_scores(cold, group, item, score), group)
    return light if out is None else light.unionByName(out)
