import math

import pytest

from tessera.operators import evaluate


def run(spark, **how):
    results = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 10)], "query_id int, rank int, doc_id long")
    qrels = spark.createDataFrame([(1, 10, 0), (1, 11, 2), (1, 12, 3), (1, 99, 1), (3, 5, 1)], "query_id int, doc_id long, relevance int")
    return {r["query_id"]: r for r in evaluate.metrics(results, qrels, k=3, base=2, **how).collect()}


def test_metrics(spark):
    got = run(spark)
    assert set(got) == {1, 3}
    one = got[1]
    assert one["precision"] == pytest.approx(2 / 3) and one["recall"] == pytest.approx(2 / 3)
    assert one["average_precision"] == pytest.approx((1 / 2 + 2 / 3) / 3)
    assert one["dcg"] == pytest.approx(0 + 2 / 1 + 3 / math.log2(3))
    assert [got[3][c] for c in ("precision", "recall", "average_precision", "dcg")] == [0, 0, 0, 0]
    other = run(spark, variant="plain", dcg="constant")[1]
    assert other["average_precision"] == pytest.approx((0 + 1 / 2 + 2 / 3) / 3) and other["dcg"] == pytest.approx(5 / math.log2(3))
    with pytest.raises(ValueError):
        run(spark, variant="x")


def test_judgments_with_nulls_and_repeats(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 1, 2), (1, 2, None)], "query_id int, doc_id long, relevance int")
    assert {tuple(r) for r in evaluate.unique_judgments(rows, ["relevance"]).collect()} == {(1, 1, 2), (1, 2, 0)}
