import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import heavy, tree


@pytest.mark.parametrize(("partitions", "fan_in"), [(1, 2), (13, 2), (20, 8)])
def test_counts_against_brute_force(spark, partitions, fan_in):
    rng = random.Random(partitions)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, *range(-5, 100_000, 977)])) for _ in range(5000)] + [("none", None), ("big", 2**62), ("big", -(2**62))]
    df = spark.createDataFrame(rows, "term string, doc_id long").repartition(partitions).withColumn("k", F.lit(1)).withColumn("n", F.lit(2))
    want = {}
    for t, d in rows:
        want.setdefault(t, set()).update([] if d is None else [d])
    got = {r["term"]: r["n_distinct"] for r in tree.tree_count_distinct(df, "term", "doc_id", fan_in).collect()}
    assert got == {t: len(s) for t, s in want.items()}


def test_empty_and_bad_arguments(spark):
    empty = spark.createDataFrame([], "term string, doc_id long")
    assert tree.tree_count_distinct(empty, "term", "doc_id").count() == 0
    with pytest.raises(ValueError):
        tree.tree_count_distinct(empty, "term", "doc_id", 1)


def test_term_documents(spark):
    postings = spark.createDataFrame([("a ", 1, 1), ("a", 1, 2), ("a", 2, None), (None, 3, 1), ("p", 1, 1)], "term string, doc_id long, tf int")
    lexicon = spark.createDataFrame([(0, "a", 1), (0, "a  ", 1), (1, "a", 1), (2, "a", None), (0, "l", None), (0, None, 9)], "spimi_block int, term string, df int")
    got = {tuple(r) for r in tree.term_documents(postings, lexicon).collect()}
    assert got == {("a", 2, 2), ("p", 1, 0), ("l", 0, 0)}


@pytest.mark.parametrize("least", [1, 500, 10**9])
def test_heavy_or_not_makes_no_difference(spark, least):
    """Keys in the tree or out of it, more chunks than estimated, extra columns with clashing names."""
    rows = [("hot", i % 900) for i in range(3000)] + [(f"k{i}", i) for i in range(200)] + [(None, 1), (None, 1), ("k1", None)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(64).withColumn("heavy", F.lit(1)).withColumn("chunk", F.lit(2))
    got = {r["k"]: r["n_distinct"] for r in tree.tree_count_distinct(df, "k", "v", 2, least=least).collect()}
    want = {"hot": 900, None: 1, **{f"k{i}": 1 for i in range(200)}}
    assert got == want


def test_wrong_number_of_chunks(spark, monkeypatch):
    """More chunks than the rounds were made for."""
    found = heavy.heavy_keys
    monkeypatch.setattr(tree, "heavy_keys", lambda *a: heavy.Heavy(found(*a).keys, 1, 2))
    monkeypatch.setattr(tree, "chunked", lambda x: (x, 2))
    df = spark.createDataFrame([("hot", i % 700) for i in range(5000)], "k string, v long").repartition(50)
    assert tree.tree_count_distinct(df, "k", "v", 2, least=10).first()["n_distinct"] == 700


def test_rounds(spark, monkeypatch):
    """A table known to have many chunks takes logarithmically many rounds, each an exchange."""
    monkeypatch.setattr(tree, "heavy_keys", lambda *a: heavy.Heavy(["hot"], 1, 64))
    monkeypatch.setattr(tree, "chunked", lambda x: (x, 64))
    df = spark.createDataFrame([("hot", i % 700) for i in range(5000)], "k string, v long").repartition(64)
    counted = tree.tree_count_distinct(df, "k", "v", 4)
    assert counted.first()["n_distinct"] == 700
    plan = counted._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


@pytest.mark.parametrize("most", [1, 200, 1 << 20])
def test_heavy_keys(spark, monkeypatch, most):
    monkeypatch.setattr(heavy, "chunked", lambda x: (x, most))
    df = spark.range(20_000).selectExpr("if(id % 2 = 0, 'a', if(id % 3 = 0, null, concat('x', id))) AS k").repartition(5)
    found = heavy.heavy_keys(df, "k", least=100)
    assert found.keys == ["a"] and found.counts == [10_000] and found.rows == 20_000 - 3333 and found.chunks == 5
    assert heavy.heavy_keys(df.filter("k IS NULL"), "k").keys == []


@pytest.mark.parametrize("listed", [1000, 0])
def test_split(spark, monkeypatch, listed):
    monkeypatch.setattr(heavy, "_WRITTEN_OUT", listed)
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    for nulls in (True, False):
        found = heavy.Heavy(["a"], 0, 1).split(df, "k", nulls)
        rows = [sorted(str(r["k"]) for r in x.collect()) for x in found]
        assert rows == ([["None", "a"], ["b"]] if nulls else [["a"], ["None", "b"]])
