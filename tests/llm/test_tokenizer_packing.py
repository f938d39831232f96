import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import packing, tokenizer

ALPHABET = st.sampled_from(list("aéß漢字ไทย🍋🍋 \n\t'sdlve01.,—") + ["  ", "    ", "'s", "don't", "<|endoftext|>", "\r\n", "\xa0", "xxxxxxxx", "========"])


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=120).map("".join), st.integers(1, 30))
def test_pieces_join_to_the_whole(text, piece):
    where = tokenizer.cuts(text, piece)
    edges = [0, *(p for p, _ in where), len(text)]
    assert all(0 < b - a <= piece for a, b in zip(edges, edges[1:])) or not text
    pieces = [tokenizer.encode(text[a:b]) for a, b in zip(edges, edges[1:])]
    assert tokenizer.concatenate(pieces, [False, *(s for _, s in where)]).tolist() == tokenizer.encode(text).tolist()


def test_long_unsplit_text():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé漢") for _ in range(30_000))
    where = tokenizer.cuts(text, 1000)
    assert all(soft for _, soft in where)
    edges = [0, *(p for p, _ in where), len(text)]
    got = tokenizer.concatenate([tokenizer.encode(text[a:b]) for a, b in zip(edges, edges[1:])], [False, *(s for _, s in where)])
    assert (got == tokenizer.encode(text)).all()


def test_same_ids_as_the_json_vocabulary():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(tokenizer.DEFAULT_RANKS.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    for text in ("Hello, world!  don't", "漢字かな交じり文 ไทย\n\n\t x", "<|endoftext|> 12345", "é" * 50):
        assert other.encode(text, add_special_tokens=False).ids == tokenizer.encode(text).tolist()


def test_token_ids(spark):
    texts = {1: "plain text", 2: "", 3: None, 4: " \n ", 5: "word " * 3000, 6: "x" * 9000, 7: "字" * 4000, 8: "plain text"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("piece", F.lit(1))
    got = {r["doc_id"]: r["ids"] for r in tokenizer.token_ids(df, piece=1000).collect()}
    assert got == {i: tokenizer.encode(t or "").tolist() for i, t in texts.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in tokenizer.token_counts(df, piece=1000).collect()} == {i: len(x) for i, x in got.items()}
    assert tokenizer.token_ids(df.limit(0)).count() == 0


def test_one_reading_and_no_shuffle(spark, tmp_path, monkeypatch):
    """Batches of long texts go out in parts; the corpus is read once."""
    monkeypatch.setattr(tokenizer, "BATCH_TOKENS", 10)
    spark.createDataFrame([(i, f"some words {i} " * 20) for i in range(9)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    coded = tokenizer.token_ids(df, piece=50)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    run = tokenizer._over_texts(tokenizer._id_lists, "ids", tokenizer.DEFAULT_RANKS, 50)
    parts = list(run(iter(df.toArrow().to_batches())))
    assert len(parts) == 9 and [p.column(0)[0].as_py() for p in parts] == list(range(9))
    assert {r["doc_id"]: r["ids"] for r in coded.collect()} == {i: tokenizer.encode(f"some words {i} " * 20).tolist() for i in range(9)}


def check(sizes, rows, capacity):
    """Whole, in order, within capacity, and without gaps in containers or numbers."""
    parts, containers = {}, {}
    for r in rows:
        parts.setdefault(r["doc_id"], []).append((r["part"], r["start"], r["n_tokens"]))
        containers.setdefault(r["container"], []).append((r["position"], r["n_tokens"]))
    assert set(parts) == {d for d, n in sizes.items() if n and n > 0}
    for d, found in parts.items():
        at = 0
        for i, (part, start, n) in enumerate(sorted(found)):
            assert (part, start) == (i, at)
            at += n
            assert n == capacity or i == len(found) - 1
        assert at == sizes[d]
    assert set(containers) == set(range(len(containers)))
    for found in containers.values():
        at = 0
        for position, n in sorted(found):
            assert position == at
            at += n
        assert at <= capacity


@pytest.mark.parametrize("seed", range(3))
def test_packing(spark, seed):
    rng = random.Random(seed)
    sizes = {i: rng.choice([None, 0, 1, 5, 5, 5, 17, 40, 64, 65, 128, 500, rng.randint(1, 64)]) for i in range(700)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens int").withColumn("rank", F.lit(0)).withColumn("container", F.lit(0)).repartition(5)
    packed = packing.pack(df, capacity=64, chunk_items=20)
    rows = packed.collect()
    check(sizes, rows, 64)
    assert tuple(packing.checks(packed, 64).first()) == (sum(1 for n in sizes.values() if n), 0, 0, 0, 0)
    f = packing.fill(packed, 64).first()
    assert f["fill"] > 0.95 and f["containers"] <= f["least"] * 1.06 + 1


def test_packing_nothing(spark):
    empty = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, n_tokens int")
    assert packing.pack(empty).count() == 0
    assert packing.fill(packing.pack(empty)).first()["containers"] == 0


def test_plan_takes_every_item_once():
    rng = np.random.default_rng(zlib.crc32(b"plan"))
    for _ in range(50):
        histogram = {int(k): int(rng.integers(1, 40)) for k in rng.integers(1, 101, 12)}
        places = packing.plan(histogram, 100)
        for length, count in histogram.items():
            mine = places[places[:, 0] == length]
            assert mine[:, 2].sum() == count and (np.cumsum(mine[:, 2])[:-1] == mine[1:, 1]).all()
