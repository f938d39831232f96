import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import frequency, topn


@pytest.mark.parametrize("least", [1, 600, 10**9])
def test_frequencies_against_brute_force(spark, least):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot  ", "hot", "warm", "a", "b ", "", None]), rng.choice([None, *range(-3, 90_000, 1201)]), rng.choice([None, 1, 2, 5])) for _ in range(4000)]
    rows += [("once", 7, 1), ("null", None, 3)]
    df = spark.createDataFrame(rows, "term string, doc_id long, tf int").repartition(7).withColumn("df", F.lit("x")).withColumn("range", F.lit(1))
    want = {}
    for t, d, tf in rows:
        if t is not None:
            docs, total = want.setdefault(t.rstrip(" "), (set(), []))
            docs.update([] if d is None else [d])
            total.append(tf or 0)
    got = {r["term"]: (r["df"], r["cf"]) for r in frequency.term_frequencies(df, least=least).collect()}
    assert got == {t: (len(d), sum(n)) for t, (d, n) in want.items()}


def test_no_sort_and_bounded_light_terms(spark):
    df = spark.createDataFrame([("hot" if i % 2 else f"t{i}", i, 1) for i in range(2000)], "term string, doc_id long, tf int")
    plan = frequency.term_frequencies(df, least=10)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "Union" in plan


def test_marks(spark):
    counts = spark.createDataFrame([("r", 2, 1), ("m", 3, 1), ("e", 4, 1), ("c", 5, 1)], "term string, df long, cf long")
    index = spark.createDataFrame([(i % 10,) for i in range(15)], "doc_id long")
    assert {r["term"]: r["mark"] for r in frequency.marked(counts, index).collect()} == {"r": "rare", "m": None, "e": None, "c": "common"}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "term string, doc_id long, tf int")
    assert frequency.term_frequencies(empty).count() == 0
    hits = spark.createDataFrame([], "query_id int, doc_id long, score double")
    assert topn.top_n(hits, "query_id", "doc_id", "score", 3).count() == 0


@pytest.mark.parametrize("hot_rows", [10**9, 60, 0])
def test_top_n_against_brute_force(spark, hot_rows):
    rng = random.Random(4)
    scores = [None, float("nan"), 0.0, -0.0, 1.5, 2.5, 2.5, -3.0, float("inf")]
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(40)]), rng.choice(scores)) for _ in range(900)] + [(9, None, 1.0), (8, 1, None)]
    df = spark.createDataFrame(rows, "query_id int, doc_id long, score double").repartition(5).withColumn("rank", F.lit(1)).withColumn("rows", F.lit(1))
    best = {}
    for q, d, s in rows:
        if q is not None and d is not None and s is not None and s == s:
            best.setdefault(q, {})[d] = max(s, best.get(q, {}).get(d, s))
    want = {(q, d, r + 1) for q, items in best.items() for r, (d, _) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0]))[:10])}
    got = topn.top_n(df, "query_id", "doc_id", "score", 10, hot_rows=hot_rows).collect()
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in got} == want and len(got) == len(want)


def test_top_n_needs_n(spark):
    with pytest.raises(ValueError):
        topn.top_n(spark.createDataFrame([], "q int, d long, s double"), "q", "d", "s", 0)
