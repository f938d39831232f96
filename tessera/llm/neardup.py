"""Problem 5: near-duplicate records, by MinHash banding with verification on the full sets.

Texts become sets of word n-grams. Equal sets are collapsed first, so copies cost one comparison, however many there are.
Each distinct set sends one row a band; sets that share a band are candidates if their sketches (two bits of each of 56
minima) and sizes, which travel with the band, leave the threshold within reach; candidates are verified on the complete
n-gram sets of the texts.

The number of bands follows from the rows a band and the wanted recall at the threshold: b = ln(1-recall)/ln(1-t^r).
A bucket of more than ``block`` sets is compared in blocks, every block with every other, spread over the cluster. Buckets
that a sketch names as holding a good share of all rows are divided where they are read; any other is divided by the task
that meets it. There is no limit on the number or the size of either, and no partner is dropped.

A set is named by 64 bits where candidates are sought and by 128 bits where sets are told apart: candidates meet all texts
of their 64-bit names, and each is verified by itself.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.operators.heavy import heavy_keys
from tessera.plans.lineage import cut

_BITS = 56
_PUNCTUATION = string.punctuation.encode()
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
_BLANKS = bytes.maketrans(b"\t\r\n", b"   ")


@dataclass(frozen=True)
class Banding:
    """threshold: least Jaccard similarity; shingle: words of an n-gram; min_size: least n-grams of a set that counts;
    rows, recall: rows a band (0: by the number of records) and wanted recall of pairs just at the threshold; block: sets that are compared at once;
    crowded: size from which a bucket may be divided where it is read; probe: one set in so many is looked at to find
    such buckets."""

    threshold: float = 0.8
    shingle: int = 5
    min_size: int = 1
    rows: int = 0
    recall: float = 0.96
    block: int = 8_000
    crowded: int = 20_000
    probe: int = 64

    def fitted(self, records: int, background: float = 0.15, budget: float = 1e4) -> Banding:
        """With the fewest rows a band, five at least, that make a set share bands with at most ``budget`` sets of mere
        ``background`` similarity. More rows need more bands for the same recall, so small collections take few."""
        how = self if self.rows else replace(self, rows=5)
        while not self.rows and records * how.bands * background**how.rows > budget:
            how = replace(how, rows=how.rows + 1)
        return how

    @property
    def bands(self) -> int:
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold**self.rows)))

    @property
    def agreeing(self) -> int:
        """Least equal two-bit places of a sketch: 2.6 standard deviations below what a pair at the threshold shows."""
        p = (1 + 3 * self.threshold) / 4
        return math.floor(_BITS * p - 2.6 * math.sqrt(_BITS * p * (1 - p)))


def words(text: str) -> list[bytes]:
    """Lower case, ASCII punctuation deleted, cut at runs of space, tab, carriage return and line feed."""
    return [w for w in text.lower().encode("utf-8", "surrogatepass").translate(_BLANKS, _PUNCTUATION).split(b" ") if w]


def _grams(found: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(found[i : i + n]) for i in range(max(1, len(found) - n + 1))} if found else set()


def grams(text: str, n: int) -> set[bytes]:
    """Distinct word n-grams; a text of fewer than n words is one gram of all its words."""
    return set(words(text)) if n == 1 else _grams(words(text), n)


class _Hasher:
    """64-bit hashes of grams with a bounded memory of frequent ones."""

    def __init__(self, limit: int = 500_000) -> None:
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, items: set[bytes]) -> list[int]:
        from xxhash import xxh3_64_intdigest

        known = self.known
        if len(known) > self.limit:
            known.clear()
        out = []
        for item in items:
            value = known.get(item)
            if value is None:
                value = known[item] = xxh3_64_intdigest(item)
            out.append(value)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _identified(how: Banding) -> Callable:
    """(key, text) to (set_id, other, key, text) for sets of at least min_size grams. set_id, other: order-free 64-bit sums of
    the grams' hashes, mixed in two ways.
    The text goes on as what its n-grams need: its words, for single words each once; and only with the first of equal
    sets that a task meets, so that many copies send little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        met: set[tuple[int, int]] = set()
        for batch in batches:
            kept, flat, sizes, bare = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                listed = words(text)
                found = set(listed) if how.shingle == 1 else _grams(listed, how.shingle)
                if len(found) >= max(1, how.min_size):
                    kept.append(i)
                    sizes.append(len(found))
                    flat += hasher(found)
                    bare.append(b" ".join(dict.fromkeys(listed) if how.shingle == 1 else listed).decode("utf-8", "surrogatepass"))
            if not kept:
                continue
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            rows = batch.take(pa.array(kept, pa.int64()))
            hashes = np.array(flat, dtype=np.uint64)
            set_id = _mixed(np.add.reduceat(_mixed(hashes), starts)).view(np.int64)
            other = _mixed(np.add.reduceat(_mixed(hashes * _ODD + _ODD), starts)).view(np.int64)
            if len(met) > 2_000_000:
                met.clear()
            for i, x in enumerate(zip(set_id.tolist(), other.tolist())):
                if x in met:
                    bare[i] = None
                else:
                    met.add(x)
            yield pa.RecordBatch.from_arrays([pa.array(set_id), pa.array(other), rows.column(0), pa.array(bare, pa.string())], names=["set_id", "other", "key", "text"])

    return run


def signatures(hash_lists: list[list[int]], how: Banding) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys (sets x bands, uint64) and sketches: the lowest bits of 56 minima over 8 bits of size, and their second bits."""
    sizes = np.array([len(h) for h in hash_lists])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.fromiter((x for h in hash_lists for x in h), dtype=np.uint64, count=int(sizes.sum()))
    rng = np.random.default_rng(20_240_229)
    n = max(how.bands * how.rows, _BITS)
    factors = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(0, 2**63, n, dtype=np.uint64)
    keys = np.tile(np.arange(1, how.bands + 1, dtype=np.uint64), (len(sizes), 1))
    sketch, second = np.minimum(sizes, 255).astype(np.uint64), np.zeros(len(sizes), dtype=np.uint64)
    flat = _mixed(flat)
    for i in range(n):
        low = _mixed(np.minimum.reduceat(flat * factors[i] + offsets[i], starts))
        band = i // how.rows
        if band < how.bands:
            keys[:, band] = _mixed(keys[:, band] * np.uint64(0xD6E8FEB86659FD93) + low)
        if i < _BITS:
            sketch |= (low & np.uint64(1)) << np.uint64(8 + i)
            second |= (low >> np.uint64(1) & np.uint64(1)) << np.uint64(8 + i)
    return keys, sketch, second


def _banded(how: Banding) -> Callable:
    """(set_id, text) to one row for each band: band key, set_id, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys, sketch, second = signatures([hasher(grams(t, how.shingle)) for t in batch.column(1).to_pylist()], how)
            over = [np.repeat(x, how.bands) for x in (batch.column(0).to_numpy(), sketch.view(np.int64), second.view(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *map(pa.array, over)], names=["band", "set_id", "sketch", "second"])

    return run


def _plausible(x: np.ndarray, y: np.ndarray, x2: np.ndarray, y2: np.ndarray, how: Banding) -> np.ndarray:
    """Whether two sketches leave the threshold within reach."""
    same = _BITS - np.bitwise_count((x ^ y | x2 ^ y2) >> np.uint64(8))
    m, n = x & np.uint64(255), y & np.uint64(255)
    ratio = np.minimum(m, n) >= how.threshold * np.maximum(m, n) - 1e-9
    return (same >= how.agreeing) & (ratio | (np.maximum(m, n) == 255))


_WORK = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("x", pa.int64()), ("y", pa.int64())])


def _work(i, j, block, a, b, x, y) -> pa.RecordBatch:
    """Rows of one form for two things: candidates (block -1; a, b), and sets still to be compared (band a, set b, sketch x, y),
    of a block, for the comparison of blocks i and j of their bucket."""
    n = len(a)
    full = lambda v: pa.array(np.full(n, v, dtype=np.int32) if np.isscalar(v) else v.astype(np.int32))
    return pa.RecordBatch.from_arrays([full(i), full(j), full(block), *(pa.array(np.broadcast_to(v, n).astype(np.int64)) for v in (a, b, x, y))], schema=_WORK)


def _found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return _work(0, 0, -1, np.minimum(a, b), np.maximum(a, b), 0, 0)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Batches sorted by their first columns to whole groups: the columns, and where each group starts. Only the last,
    unfinished group is held between batches."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        new = [c.to_numpy() for c in batch.columns]
        if held and all(new[k][-1] == held[0][k][0] for k in range(keys)):
            held.append(new)  # one group throughout: wait for its end
            continue
        columns = [np.concatenate(x) for x in zip(*held, new)] if held else new
        starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns[:keys]], axis=0)]))
        if starts[-1]:
            yield [c[: starts[-1]] for c in columns], starts[:-1]
        held = [[c[starts[-1] :] for c in columns]]
    if held:
        yield [np.concatenate(x) for x in zip(*held)], np.array([0])


def _bucket_pairs(how: Banding) -> Callable:
    """Rows sorted by band to candidates. The sets of a bucket of more than a block go on as work for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, ids, sketch, second), starts in _groups(batches, 1):
            sizes = np.diff(np.append(starts, len(band)))
            for at, n in zip(starts[sizes > how.block], sizes[sizes > how.block]):
                place = np.arange(n) // how.block
                blocks, s = int(place[-1]) + 1, slice(at, at + n)
                for other in range(blocks):
                    yield _work(np.minimum(place, other), np.maximum(place, other), place, band[s], ids[s], sketch[s], second[s])
            x, y = sketch.view(np.uint64), second.view(np.uint64)
            left = np.repeat(starts + sizes, sizes) - np.arange(len(band))  # rows to the end of the bucket
            alive = np.flatnonzero((left > 1) & np.repeat(sizes <= how.block, sizes))
            gap = 1
            while len(alive):
                near = alive[_plausible(x[alive], x[alive + gap], y[alive], y[alive + gap], how) & (ids[alive] != ids[alive + gap])]
                if len(near):
                    yield _found(ids[near], ids[near + gap])
                gap += 1
                alive = alive[left[alive] > gap]

    return run


def _block_pairs(how: Banding) -> Callable:
    """Rows sorted by (band, i, j): candidates go through, blocks are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, _ in _groups(batches, 3):
            done = columns[3] < 0
            if done.any():
                yield _found(columns[0][done], columns[4][done])
            a, i, j, block, b, x, y = (c[~done] for c in columns)
            starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])) if len(a) else a
            for at, end in zip(starts, np.append(starts[1:], len(a))):
                one, ids, first, second = i[at] == j[at], b[at:end], x[at:end].view(np.uint64), y[at:end].view(np.uint64)
                left = np.flatnonzero(block[at:end] == i[at])
                right = left if one else np.flatnonzero(block[at:end] != i[at])
                for k in left:
                    near = right[_plausible(first[k], first[right], second[k], second[right], how)]
                    near = near[ids[near] > ids[k]] if one else near[ids[near] != ids[k]]
                    if len(near):
                        yield _found(np.full(len(near), ids[k]), ids[near])

    return run


def _verified(how: Banding) -> Callable:
    """(a, other_a, b, other_b, text_a, text_b) to those of the first four whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, first = [], None, set()
            for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                if y is not last:
                    first, last = grams(y, how.shingle), y
                second = grams(x, how.shingle)
                common = len(first & second)
                keep.append(common >= how.threshold * (len(first) + len(second) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "other_a", "b", "other_b"]).filter(pa.array(keep, pa.bool_()))

    return run


@dataclass(frozen=True)
class NearDuplicates:
    """members: (set_id, other, key), every record that counts, once; links: (a, other_a, b, other_b), similar sets, each pair
    once. A set is named by both its numbers."""

    members: DataFrame
    links: DataFrame


def near_duplicates(records: DataFrame, key: str, text: str, how: Banding = Banding()) -> NearDuplicates:
    """Sets and links of records(key, text). Null texts and sets under ``min_size`` are left out; of a key delivered
    several times each distinct text counts. Keys lose trailing blanks. Other columns are ignored."""
    how = how.fitted(records.count())
    rows = records.select(F.rtrim(F.col(key).cast("string")).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull() & F.col("key").isNotNull())
    identified = "set_id bigint, other bigint, key string, text string"
    named = rows.mapInArrow(_identified(how), identified).filter("set_id IS NOT NULL AND key IS NOT NULL")
    # one text a set, partitioned by set_id once and met again for verification: every use reads the same columns under
    # the same filter, so that all share one shuffle. A set that a third of all records share sends one row a task
    texts = named.filter("text IS NOT NULL").select("set_id", "other", "text").repartition("set_id").groupBy("set_id", "other").agg(F.first("text").alias("text"))
    # by all columns, so that the members of one set spread
    members = named.select("set_id", "other", "key").distinct()
    bands = "band bigint, set_id bigint, sketch bigint, second bigint"
    unbanded = texts.select("set_id", "text", "other")

    some = rows.filter(F.pmod(F.xxhash64("text"), F.lit(how.probe)) == 0).mapInArrow(_identified(how), identified)
    probe = some.filter("text IS NOT NULL").select("set_id", "text").dropDuplicates(["set_id"]).mapInArrow(_banded(how), bands)
    crowded = heavy_keys(probe, "band", max(2, how.crowded // how.probe))

    held, banded = crowded.split(unbanded.mapInArrow(_banded(how), bands), "band")
    work = banded.repartition("band").sortWithinPartitions("band").mapInArrow(_bucket_pairs(how), ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'bigint'}" for f in _WORK))
    if held is not None:
        # as many blocks as the probe makes likely; a block may turn out larger, which costs time, not results
        blocks = [(k, max(1, -(-n * how.probe // how.block))) for k, n in zip(crowded.keys, crowded.counts)]
        names = F.broadcast(records.sparkSession.createDataFrame(blocks, "band bigint, blocks int"))
        split = held.join(names, "band").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
        split = split.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        work = work.unionByName(split.select(
            F.least("block", "at").alias("i"), F.greatest("block", "at").alias("j"), "block", F.col("band").alias("a"),
            F.col("set_id").alias("b"), F.col("sketch").alias("x"), F.col("second").alias("y"),
        ))
    # candidates by both sets, so that those of a hub spread; blocks by the comparison they are for
    place = F.when(F.col("block") < 0, F.xxhash64("a", "b")).otherwise(F.xxhash64("a", "i", "j"))
    spread = work.select("a", "i", "j", "block", "b", "x", "y").repartition(place).sortWithinPartitions("a", "i", "j", "block")
    unique = spread.mapInArrow(_block_pairs(how), work.schema).select("a", "b").dropDuplicates(["a", "b"])
    with_a = unique.join(texts.select(F.col("set_id").alias("a"), F.col("other").alias("other_a"), F.col("text").alias("text_a")), "a")
    with_both = with_a.join(texts.select(F.col("set_id").alias("b"), F.col("other").alias("other_b"), F.col("text").alias("text_b")), "b")
    links = with_both.select("a", "other_a", "b", "other_b", "text_a", "text_b").mapInArrow(_verified(how), "a bigint, other_a bigint, b bigint, other_b bigint")
    return NearDuplicates(members, links)


def record_pairs(found: NearDuplicates) -> DataFrame:
    """(key_a, key_b), key_a < key_b: every pair of different records with similar or equal sets, each once."""
    m = found.members
    a = m.select(F.col("set_id").alias("a"), F.col("other").alias("other_a"), F.col("key").alias("ka"))
    b = m.select(F.col("set_id").alias("b"), F.col("other").alias("other_b"), F.col("key").alias("kb"))
    across = found.links.join(b, ["b", "other_b"]).join(a, ["a", "other_a"]).select("ka", "kb")
    within = a.join(b, (F.col("a") == F.col("b")) & (F.col("other_a") == F.col("other_b"))).filter(F.col("ka") < F.col("kb")).select("ka", "kb")
    ordered = across.unionByName(within).select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))
    return ordered.filter(F.col("key_a") != F.col("key_b")).distinct()


def record_groups(found: NearDuplicates, records: DataFrame, key: str) -> DataFrame:
    """key, group_key, links: one row for each distinct non-null key of ``records``.

    ``group_key`` is the smallest key of the records connected by links, the key itself for a record without any; ``links``
    counts the records directly linked (a record with several texts counts what each of them is linked to).
    """
    sizes = found.members.groupBy("set_id", "other").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))
    # one number a set: of sets that share their 64-bit name all but one are named anew
    first = F.min("other").over(Window.partitionBy("set_id"))
    sizes = cut(sizes.withColumn("node", F.when(F.col("other") == first, F.col("set_id")).otherwise(F.xxhash64("set_id", "other"))))
    name = lambda side: sizes.select(F.col("set_id").alias(side), F.col("other").alias(f"other_{side}"), F.col("node").alias(f"node_{side}"))
    links = found.links.join(name("a"), ["a", "other_a"]).join(name("b"), ["b", "other_b"]).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    links = cut(links)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(sizes.select(F.col("node").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("other_records"))
    # a record with several texts ties its sets together
    members = found.members.join(sizes.select("set_id", "other", "node"), ["set_id", "other"]).select("node", "key")
    ties = members.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    tied = members.join(ties, "key").select("a", F.col("node").alias("b")).filter("a <> b")
    parts = components(links.unionByName(tied)).withColumnRenamed("node", "in_component")
    labelled = sizes.join(parts, F.col("node") == F.col("in_component"), "left").select("node", "n", "least", F.coalesce("component", "node").alias("component"))
    names = labelled.groupBy("component").agg(F.min("least").alias("group_key"))
    per_set = labelled.join(names, "component").join(degree, F.col("node") == F.col("a"), "left")
    per_set = per_set.select("node", "group_key", (F.col("n") - 1 + F.coalesce("other_records", F.lit(0))).alias("links"))
    linked = members.join(per_set, "node").groupBy("key").agg(F.min("group_key").alias("group_key"), F.sum("links").alias("links"))
    every = records.select(F.rtrim(F.col(key).cast("string")).alias("key")).filter(F.col("key").isNotNull()).distinct()
    return every.join(linked, "key", "left").select("key", F.coalesce("group_key", "key").alias("group_key"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
