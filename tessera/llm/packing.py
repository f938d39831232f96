"""Problem 7: filling containers of fixed capacity, by shortest-pack-first over the length histogram.

Only the histogram, at most ``capacity`` counts, comes to the driver. Lengths are placed longest first, each into the
pack with most room, a pack standing for all containers of one pattern. The resulting places, ranges of ranks within a
length, are joined back to the items by rank; ranks are counted in chunks, so a length that a third of all items share is
no task's burden.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import chunked_row_number
from tessera.plans.lineage import cut

CAPACITY = 2048
#: Items of one length that are ranked together.
CHUNK_ITEMS = 1 << 18


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Places for items of the given lengths: rows (length, first rank, count, first container, offset), by length and rank.

    A pack is (room, first container, how many containers it stands for). The pack with most room (of equal ones that
    with the smaller container number) takes the next item while any has room enough; else a new pack opens. Where a pack
    stands for more containers than there are items left, it splits.
    """
    packs: list[tuple[int, int, int]] = []
    places, containers = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if packs and -packs[0][0] >= length:
                room, first, width = heapq.heappop(packs)
                used = min(width, left)
                if used < width:
                    heapq.heappush(packs, (room, first + used, width - used))
            else:
                room, first, used = -capacity, containers, left
                containers += left
            places.append((length, rank, used, first, capacity + room))
            if -room > length:
                heapq.heappush(packs, (room + length, first, used))
            rank, left = rank + used, left - used
    out = np.array(places, dtype=np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack(sizes: DataFrame, capacity: int = CAPACITY, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """doc_id, part, start, n_tokens, container, position for sizes(doc_id, n_tokens); doc_id must be unique.

    ``start`` is the part's first token in its document, ``position`` its place in the container. Documents of at most
    ``capacity`` tokens are one part; longer ones are divided into full parts and a rest. Documents of 0, negative or null
    size take no place. Containers are numbered from 0 without gaps. An empty table gives no rows.
    """
    n = F.col("n_tokens").cast("long")
    starts = F.sequence(F.lit(0).cast("long"), n - 1, F.lit(capacity).cast("long"))
    parts = cut(
        sizes.filter(n > 0).select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"), F.posexplode(starts).alias("part", "start"))
        .select("doc_id", "part", "start", F.least(F.lit(capacity), F.col("n") - F.col("start")).cast("int").alias("n_tokens"))
    )
    histogram = {r["n_tokens"]: r["n"] for r in parts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = plan(histogram, capacity)
    length, first_rank, container, offset = places[:, 0], places[:, 1], places[:, 3], places[:, 4]
    key = (length << 44) + first_rank

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.searchsorted(key, (batch["n_tokens"].to_numpy(np.int64) << 44) + batch["rank"].to_numpy(np.int64), side="right") - 1
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "part": batch["part"], "start": batch["start"], "n_tokens": batch["n_tokens"],
                "container": container[at] + batch["rank"] - first_rank[at], "position": offset[at],
            })

    # a length has as many chunks as its count asks for: one row each, and one for every chunk_items items besides
    chunks = [(int(x), -(-n // chunk_items)) for x, n in histogram.items()]
    known = sizes.sparkSession.createDataFrame(chunks, "n_tokens int, _chunks int")
    ordered = parts.join(F.broadcast(known), "n_tokens").withColumn("_order", F.struct("doc_id", "part"))
    by_chunk = F.pmod(F.xxhash64("doc_id", "part"), F.col("_chunks"))
    ranked = chunked_row_number(ordered, "n_tokens", "_order", by_chunk, few=True)
    return ranked.select("doc_id", "part", "start", "n_tokens", "rank").mapInPandas(
        place, "doc_id bigint, part int, start bigint, n_tokens int, container bigint, position int"
    )


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """containers, tokens, least (containers that no packing can undercut), fill: one row."""
    total = packed.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.max("container") + 1, F.lit(0)).alias("containers"))
    return total.select(
        "containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"),
        F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * capacity)).alias("fill"),
    )


def checks(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """documents, over_full, with_gaps, divided_short, missing_numbers: one row; all but the first are 0 for a sound packing."""
    ends = F.col("position") + F.col("n_tokens")
    of = packed.groupBy("container").agg(F.sum("n_tokens").alias("tokens"), F.max(ends).alias("end"), F.sum(F.when(F.col("position") == 0, 1).otherwise(0)).alias("firsts"))
    count = lambda condition: F.coalesce(F.sum(condition.cast("long")), F.lit(0))
    containers = of.agg(
        count(F.col("end") > capacity).alias("over_full"), count((F.col("tokens") != F.col("end")) | (F.col("firsts") != 1)).alias("with_gaps"),
        F.coalesce(F.max("container") + 1 - F.count(F.lit(1)), F.lit(0)).alias("missing_numbers"),
    )
    parts = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("n"), F.max(F.col("start") + F.col("n_tokens")).alias("end"))
    whole = F.col("n") == F.col("end")
    documents = parts.agg(count(whole).alias("documents"), count((F.col("parts") > 1) & (F.col("n") <= capacity)).alias("divided_short"))
    return documents.crossJoin(containers).select("documents", "over_full", "with_gaps", "divided_short", "missing_numbers")
