import random
import string

import pytest
from pyspark.sql import functions as F

from tessera.llm import components, neardup

WORDS = neardup.Banding(threshold=0.7, shingle=1, min_size=10)


def corpus(seed, families=30, copies=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(3000)]
    rows = []
    for f in range(families):
        base = rng.sample(vocabulary, rng.randint(12, 40))
        for c in range(copies):
            words = [w if rng.random() > 0.08 else rng.choice(vocabulary) for w in base]
            rng.shuffle(words)
            rows.append((f"d{f:03}-{c}", " ".join(words)))
    return rows


def brute(rows, how):
    sets = [(k.rstrip(" "), neardup.grams(t, how.shingle)) for k, t in rows if k is not None and t is not None]
    sets = [(k, s) for k, s in sets if len(s) >= how.min_size and s]
    return {
        (min(a, b), max(a, b))
        for i, (a, x) in enumerate(sets) for b, y in sets[:i]
        if a != b and len(x & y) >= how.threshold * len(x | y) - 1e-9
    }


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_no string, text string").withColumn("set_id", F.lit(1)).withColumn("key", F.lit("x")).repartition(5)


@pytest.mark.parametrize(("crowded", "block"), [(20_000, 8_000), (20_000, 2), (4, 2)])
def test_pairs_and_groups(spark, crowded, block):
    """Whole buckets, buckets divided by the task that meets them, and buckets divided where they are read."""
    how = neardup.Banding(threshold=0.7, shingle=1, min_size=10, crowded=crowded, block=block, probe=1)
    rows = corpus(1) + [("same1", "a b c d e f g h i j k"), ("same2  ", "K, j i h. g f e d c b a!"), ("same2", "K, j i h. g f e d c b a!"), ("few", "a b c"), ("null", None), ("blank", " \n"), (None, "x")]
    df = frame(spark, rows)
    found = neardup.near_duplicates(df, "doc_no", "text", how)
    got = [(r["key_a"], r["key_b"]) for r in neardup.record_pairs(found).collect()]
    want = brute(rows, how)
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.97 * len(want) and ("same1", "same2") in got
    groups = {r["key"]: (r["group_key"], r["links"]) for r in neardup.record_groups(found, df, "doc_no").collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    links = dict.fromkeys(groups, 0)
    for a, b in got:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
        links[a] += 1
        links[b] += 1
    assert groups == {k: (root(k), n) for k, n in links.items()}
    assert set(groups) == {k.rstrip(" ") for k, _ in rows if k is not None}


def test_many_crowded_buckets(spark):
    """400 sets of very similar words fill every bucket far beyond the block size; every pair comes out."""
    rng = random.Random(5)
    base = [f"word{i}" for i in range(200)]
    rows = [(f"k{i}", " ".join([w for w in base if rng.random() > 0.004] + [f"own{i}"])) for i in range(400)]
    how = neardup.Banding(threshold=0.7, shingle=1, min_size=10, block=16)
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_no string, text string"), "doc_no", "text", how)
    assert neardup.record_pairs(found).count() == 400 * 399 // 2


def test_sets_that_share_a_name(spark):
    """Different sets with equal 64-bit names stay different sets."""
    rows = [("a", "one two three four five six seven eight nine ten x"), ("b", "one two three four five six seven eight nine ten y"), ("c", "far off other words that have not any thing in common"), ("d", "far off other words that have not any thing in common")]
    how = neardup.Banding(threshold=0.7, shingle=1, min_size=10)
    df = spark.createDataFrame(rows, "doc_no string, text string")
    found = neardup.near_duplicates(df, "doc_no", "text", how)
    sets = {r["key"]: (r["set_id"], r["other"]) for r in found.members.collect()}
    same = F.col("set_id").isin(sets["a"][0], sets["c"][0])
    mapped = found.members.withColumn("set_id", F.when(same, F.lit(7)).otherwise(F.col("set_id")))
    links = found.links.withColumn("a", F.when(F.col("a") == sets["a"][0], F.lit(7)).otherwise(F.col("a"))).withColumn("b", F.when(F.col("b") == sets["a"][0], F.lit(7)).otherwise(F.col("b")))
    renamed = neardup.NearDuplicates(mapped, links)
    assert {tuple(r) for r in neardup.record_pairs(renamed).collect()} == {("a", "b"), ("c", "d")}
    assert {tuple(r) for r in neardup.record_groups(renamed, df, "doc_no").collect()} == {("a", "a", 1), ("b", "a", 1), ("c", "c", 1), ("d", "c", 1)}


def test_word_five_grams(spark):
    rng = random.Random(2)
    text = [f"w{rng.randint(0, 500)}" for _ in range(200)]
    other = list(text)
    other[100] = "changed"
    rows = [("a", " ".join(text)), ("b", " ".join(other)), ("c", " ".join(reversed(text))), ("d", "tiny text"), ("e", "tiny text")]
    found = neardup.near_duplicates(frame(spark, rows), "doc_no", "text")
    assert {tuple(r) for r in neardup.record_pairs(found).collect()} == {("a", "b"), ("d", "e")}


def test_no_rows(spark):
    df = frame(spark, []).limit(0)
    found = neardup.near_duplicates(df, "doc_no", "text", WORDS)
    assert neardup.record_pairs(found).count() == 0
    assert neardup.record_groups(found, df, "doc_no").count() == 0


def test_bands_follow_from_recall():
    assert neardup.Banding(threshold=0.7, rows=6, recall=0.96).bands == 26
    assert WORDS.fitted(2_000_000).rows == 5 and WORDS.fitted(2_000_000).bands == 18
    large = WORDS.fitted(10**10)
    assert large.rows > 6 and 1 - (1 - 0.7**large.rows) ** large.bands >= 0.96
    assert neardup.Banding(threshold=0.8, rows=6, recall=0.99).bands == 16
    assert [neardup.words("A-b, C\td e\n")] == [[b"ab", b"c", "d e".encode()]]


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(5, 3), (3, 5), (9, 8), (7, 9), (3, 5)]])
def test_components(spark, links):
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {}
    for a, b in links:
        if a != b:
            group = want.get(a, {a}) | want.get(b, {b})
            for x in group:
                want[x] = group
    assert got == {x: min(g) for x, g in want.items()}
