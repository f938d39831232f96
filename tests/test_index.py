import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import index, ranking, retrieval
from tessera.plans.engine import SearchEngine
from tessera.sources import collection, store

THREE = [(0, "doc0", "this is a quiet harbour beyond winter"), (1, "doc1", "copper is a patient orange ferry"), (2, "doc2", "the grey heron carries reeds over the slow canal")]


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, doc_no string, text string")


def test_three_documents(spark):
    built = index.build(documents(spark, THREE))
    assert (built.stats.num_docs, built.stats.sum_len) == (3, 22)
    lex = {r["term"]: r for r in built.lexicon.collect()}
    assert len(lex) == 19
    want = {"a": (2, 0.176, 0.074), "is": (2, 0.176, 0.074), "heron": (1, 0.477, 0.166), "copper": (1, 0.477, 0.2), "quiet": (1, 0.477, 0.187), "the": (1, 0.621, 0.246)}
    for term, (df, tfidf, bm25) in want.items():
        r = lex[term]
        assert (r["df"], r["num_blocks"]) == (df, 1)
        assert r["max_tfidf"] == pytest.approx(tfidf, abs=6e-4) and r["max_bm25"] == pytest.approx(bm25, abs=6e-4)


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_partitions_do_not_matter(spark, partitions):
    one = index.build(documents(spark, THREE).repartition(partitions))
    assert {tuple(r) for r in one.postings.collect()} == {tuple(r) for r in index.build(documents(spark, THREE)).postings.collect()}


def test_odd_documents(spark):
    long = "x" * 40
    rows = [(0, "a" + " " * 29, f"{long}a {long}b"), (1, "b", None), (2, "c", ""), (3, None, "!!"), (4, "e", "w " * 5000)]
    built = index.build(documents(spark, rows).withColumn("term", F.lit(1)).withColumn("tf", F.lit(1)))
    assert {r["doc_id"]: (r["doc_no"], r["doc_len"]) for r in built.doc_index.collect()} == {0: ("a", 2), 1: ("b", 0), 2: ("c", 0), 3: (None, 0), 4: ("e", 5000)}
    assert {(r["term"], r["doc_id"], r["tf"]) for r in built.postings.collect()} == {("x" * 30, 0, 2), ("w", 4, 5000)}
    empty = index.build(documents(spark, []))
    assert empty.stats.avgdl == 0 and empty.lexicon.count() == 0


def test_blocks_and_next_geq(spark):
    rows = [(i, str(i), "aaaaa ttt" if i % 2 == 0 else "bbbbb dddd") for i in range(10_000)]
    built = index.build(documents(spark, rows))
    blocks = index.blocks_of(built.postings).cache()
    got = {(r["term"], r["block_no"]): r for r in blocks.filter("block_no = 1").collect()}
    assert blocks.groupBy("term").count().filter("count <> 71").count() == 0
    assert [(got[t, 1]["nr_postings"], got[t, 1]["min_doc_id"], got[t, 1]["max_doc_id"]) for t in ("aaaaa", "bbbbb")] == [(71, 142, 282), (71, 143, 283)]
    targets = spark.createDataFrame([("aaaaa", t) for t in (80, 81, 1850, 100_000)] + [("zzz", 1)], "term string, target long")
    assert {(r["target"], r["doc_id"], r["tf"]) for r in retrieval.next_geq(blocks, targets).collect()} == {(80, 80, 1), (81, 82, 1), (1850, 1850, 1)}


def test_weights(spark):
    from tessera.functions import scoring

    rows = spark.createDataFrame([(1, 233), (3, 256), (2, 311), (0, 5), (None, 5)], "tf int, df int")
    idf = scoring.idf(F.col("df"), F.lit(8_841_823))
    got = [r[0] for r in rows.select(scoring.tfidf(F.col("tf"), idf)).collect()]
    assert got == pytest.approx([4.579186, 6.703622, 5.794503, 0, 0], abs=1e-5)
    damped = 1 + math.log10(3)
    want = math.log10(100 / 5) * damped / (damped + 1.6 * (0.25 + 0.75 * 20 / 40))
    one = spark.range(1).select(scoring.bm25(F.lit(3), scoring.idf(F.lit(5), F.lit(100)), F.lit(20), F.lit(40.0)))
    assert one.first()[0] == pytest.approx(want)
    with pytest.raises(ValueError):
        scoring.weight("x", F.lit(1), F.lit(1), F.lit(1), F.lit(1))


def brute(rows, queries, scoring, k, conjunctive):
    docs = {i: (t or "").split() for i, _, t in rows}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {}
    for words in docs.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    out = set()
    for q, text in queries:
        terms = set((text or "").split())
        scores = []
        for d, words in docs.items():
            hit = [t for t in terms if t in words]
            if not hit or (conjunctive and len(hit) < len(terms)):
                continue
            total = 0.0
            for t in hit:
                damped, idf = 1 + math.log10(words.count(t)), math.log10(n / df[t])
                total += damped * idf if scoring == "tfidf" else idf * damped / (damped + 1.6 * (0.25 + 0.75 * len(words) / avgdl))
            scores.append((-round(total, 9), d))
        out |= {(q, r + 1, d) for r, (_, d) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("scoring", ["tfidf", "bm25"])
def test_retrieval_against_brute_force(spark, scoring):
    import random

    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i, str(i), " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    queries = [(q, " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))) for q in range(40)] + [(90, None), (91, ""), (92, "unknown w1"), (0, None)]
    built = index.build(documents(spark, rows))
    parsed = retrieval.parse_queries(spark.createDataFrame(queries, "query_id int, text string"))
    rank = lambda df: {(r["query_id"], r["rank"], r["doc_id"]) for r in df.collect()}
    want = brute(rows, queries, scoring, 7, False)
    assert rank(retrieval.daat(built, parsed, scoring, 7)) == want
    assert rank(retrieval.daat_join(built, parsed, scoring, 7)) == want
    assert rank(retrieval.maxscore(built, parsed, scoring, 7)) == want
    assert rank(retrieval.maxscore_join(built, parsed, scoring, 7)) == want
    both = brute(rows, queries, scoring, 7, True)
    assert rank(retrieval.daat(built, parsed, scoring, 7, True)) == both == rank(retrieval.maxscore(built, parsed, scoring, 7, True))
    assert rank(retrieval.daat_join(built, parsed, scoring, 7, True)) == both


def test_blocks_smaller_than_the_collection(spark, monkeypatch):
    from tessera.operators import blocks

    best = blocks._Best(1, 2)
    import numpy as np

    best.add(0, np.array([1.0, 3.0, 3.0, 2.0]), np.array([4, 9, 5, 1]))
    best.add(0, np.array([3.0]), np.array([2]))
    assert best.doc[0].tolist() == [2, 5] and best.least[0] == 3.0


def test_unknown_names(spark):
    built = index.build(documents(spark, THREE))
    parsed = retrieval.parse_queries(spark.createDataFrame([(0, "fox")], "query_id int, text string"))
    for call in (lambda: retrieval.search(built, parsed, algorithm="x"), lambda: retrieval.daat(built, parsed, "x"), lambda: retrieval.maxscore(built, parsed, "x")):
        with pytest.raises(ValueError):
            call()


def test_engine_and_store(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        store.load(spark, path)
    engine = SearchEngine.build(documents(spark, THREE), path=path, blocks=True)
    again = SearchEngine.load(spark, path, cache=True)
    for e in (engine, again):
        assert [r["doc_no"] for r in e.search("grey copper", k=5).orderBy("rank").collect()] == ["doc1", "doc2"]
    assert again.index.stats.num_terms == 19
    assert "heron 2:1" in {r[0] for r in store.render_postings(store.load_blocks(spark, path)).collect()}
    assert store.render_doc_index(again.index.doc_index).count() == 3 and store.render_lexicon(again.index.lexicon).count() == 19
    assert "Documents: 3" in store.render_stats(again.index.stats)


def test_collection_files(spark, tmp_path):
    rows = collection.from_rows(spark, [(f"d{i}", f"text {i}") for i in range(60)])
    collection.write_collection(rows, str(tmp_path / "c"))
    back = collection.read_collection(spark, str(tmp_path / "c"), 3)
    assert back.count() == 60
    assert {(r["doc_id"], r["doc_no"]) for r in collection.with_ids(back, ["doc_no"]).collect()} == set(enumerate(sorted(f"d{i}" for i in range(60))))
    (tmp_path / "h.tsv").write_text("archive-ü*77/x-head0\tA boat lies here\n1\tnext\n")
    assert [tuple(r) for r in collection.read_collection(spark, str(tmp_path / "h.tsv"), strip_header=True, partitions=1).collect()] == [("0", "A boat lies here"), ("1", "next")]
    (tmp_path / "q").write_text('3\ta "quoted text\n')
    assert [tuple(r) for r in collection.read_topics(spark, str(tmp_path / "q")).collect()] == [(3, 'a "quoted text')]
    (tmp_path / "r").write_text("1 0 5 1\n1 0 5 2\n1 Q0 6 0\n")
    assert {tuple(r) for r in collection.read_qrels(spark, str(tmp_path / "r")).collect()} == {(1, 5, 2), (1, 6, 0)}


def test_ids_in_the_order_of_the_lines(spark, tmp_path):
    """Numbers, not strings; several files, one of them empty, in many splits; gzip; blank lines and lines without a tab."""
    (tmp_path / "c").mkdir()
    lines = [f"{i}\ttext of {i} " + "x" * (i % 50) for i in range(300)]
    (tmp_path / "c" / "a.tsv").write_text("\n".join(lines[:200]) + "\n\n")
    (tmp_path / "c" / "b.tsv").write_text("")
    (tmp_path / "c" / "c.tsv").write_text("\n".join([*lines[200:], "300", "\tno number"]))
    whole = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        got = collection.read_collection(spark, str(tmp_path / "c"), numbered=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", whole)
    assert sorted((r["doc_id"], r["doc_no"]) for r in got) == [(i, str(i)) for i in range(301)]
    assert next(r for r in got if r["doc_id"] == 300)["text"] is None
    with gzip.open(tmp_path / "g.tsv.gz", "wt") as out:
        out.write("\n".join(lines))
    zipped = collection.read_collection(spark, str(tmp_path / "g.tsv.gz"), numbered=True)
    assert zipped.rdd.getNumPartitions() > 1  # spread without being asked to
    assert sorted((r["doc_id"], r["doc_no"]) for r in zipped.collect()) == [(i, str(i)) for i in range(300)]


@pytest.mark.parametrize("size", ["16m", "134217728b", "1g"])
def test_spread_reads_any_size(spark, tmp_path, size):
    (tmp_path / "a.tsv").write_text("1\ta\n2\tb\n")
    whole = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        assert collection.read_collection(spark, str(tmp_path / "a.tsv")).count() == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", whole)


def test_ids_in_the_order_of_rows(spark):
    rows = collection.from_rows(spark, [(str(i), None) for i in (9, 10, 2, 33, 1)])
    assert {(r["doc_id"], r["doc_no"]) for r in collection.with_ids(rows).collect()} == set(enumerate(["9", "10", "2", "33", "1"]))


def test_dense_ids_of_nothing(spark):
    assert ranking.dense_ids(spark.createDataFrame([], "a string"), ["a"]).count() == 0


def test_ranks_with_null_keys(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), (None, 5), (None, 2), ("a", 2)], "k string, v int")
    for few in (True, False):
        got = ranking.chunked_row_number(df, "k", "v", F.col("v") % 1, total="n", few=few).collect()
        assert {(r["k"], r["v"], r["rank"], r["n"]) for r in got} == {("a", 1, 0, 3), ("a", 2, 1, 3), ("a", 3, 2, 3), (None, 2, 0, 2), (None, 5, 1, 2)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, monkeypatch):
    """One hash aggregation for the lexicon; blocks after one shuffle, three with a heavy term's rows moved twice."""
    built = index.build(documents(spark, [(i, str(i), "common " + f"w{i % 50} " * (1 + i % 3)) for i in range(3000)]))
    assert "SortAggregate" not in plan(built.lexicon) and plan(built.lexicon).count("Exchange") == 1
    light = index.blocks_of(built.postings)
    assert plan(light).count("Exchange") == 1
    monkeypatch.setattr(index, "RANK_CHUNK", 1000)
    heavy = index.blocks_of(built.postings)
    assert plan(heavy).count("Exchange") > 1
    assert {str(r) for r in light.collect()} == {str(r) for r in heavy.collect()}


def test_pruning_reads_less_and_finds_the_same(spark):
    rows = [(i, str(i), "the of " + ("rare " * (1 + i % 4) if i % 40 == 0 else "and ") + f"w{i % 7} " * (i % 5)) for i in range(4000)]
    built = index.build(documents(spark, rows))
    topics = retrieval.parse_queries(spark.createDataFrame([(1, "the rare of"), (2, "rare of w3")], "query_id int, text string"))
    for scoring in ("bm25", "tfidf"):
        read = retrieval.postings_read(built, topics, scoring).first()
        assert 0 < read["pruned"] < read["exhaustive"]
        found = [{tuple(r) for r in run(built, topics, scoring).collect()} for run in (retrieval.maxscore, retrieval.daat, retrieval.maxscore_join)]
        assert found[0] == found[1] == found[2]
    monkey = retrieval.MAX_CANDIDATES
    try:
        retrieval.MAX_CANDIDATES = 3  # too many documents to tell: nothing is left out
        assert retrieval.postings_read(built, topics).first()["pruned"] == retrieval.postings_read(built, topics).first()["exhaustive"]
    finally:
        retrieval.MAX_CANDIDATES = monkey


def test_list_lengths(spark):
    lex = spark.createDataFrame([("a", 1), ("b", 3)], "term string, df long")
    assert tuple(index.list_lengths(lex).first()) == (2, 4, 2.0, 2.5, 3)
    assert index.list_lengths(lex.limit(0)).first()["mean"] is None


def test_cli(spark, tmp_path, capsys):
    """Judgments name documents by their place among the lines, which for numbers is not the order of their strings."""
    from tessera import cli

    words = "amber birch cedar dune ember fjord grove heath inlet jetty kelp lagoon".split()
    (tmp_path / "c.tsv").write_text("head\x00\x000\t" + "\n".join((f"{i}\t" if i else "") + f"the {w} lies near" for i, w in enumerate(words)) + "\n")
    (tmp_path / "q.tsv").write_text("0\tcedar\n1\tkelp\n2\tjetty\n")
    (tmp_path / "r").write_text("0 0 2 1\n1 0 10 1\n2 0 9 1\n")
    cli.main(["index", "--collection", str(tmp_path / "c.tsv"), "--index", str(tmp_path / "i"), "--remove-stop-words", "--strip-header"])
    cli.main(["evaluate", "--index", str(tmp_path / "i"), "--topics", str(tmp_path / "q.tsv"), "--qrels", str(tmp_path / "r"), "--remove-stop-words", "--latency", "2"])
    shown = capsys.readouterr().out
    assert [x.strip() for x in shown.split("|")[8:10]] == ["3", "1.0"] and "seconds a query" in shown


def test_no_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from tessera.plans import lineage

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError):
        lineage.ensure_checkpoint_dir(session)


def test_cut_and_release(spark):
    from pathlib import Path

    from tessera.plans import lineage

    kept = lineage.cut(spark.range(3))
    path = Path(kept._kept_at.removeprefix("file:"))
    assert kept.count() == 3 and path.exists()
    lineage.release(kept)
    lineage.release(spark.range(1))
    assert not path.exists()


@pytest.mark.parametrize("scoring", ["tfidf", "bm25"])
def test_large_query_sets_make_no_row_of_a_match(spark, scoring, monkeypatch, tmp_path):
    """A query set over the bound is dealt out to tasks; the join plan, whose matches fill the disks, is not taken."""
    import random

    from tessera.operators import blocks, bulk

    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i, str(i), " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(300)] + [(300, "300", "every " * 9), (301, "301", None)]
    rows = [(i, n, t if t is None else t + " every") for i, n, t in rows]
    queries = [(q, " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))) for q in range(40)] + [(90, None), (91, ""), (92, "unknown w1"), (93, "w1 unknown w2"), (94, "every"), (95, "every w1")]
    queries += [(q + 1000, " ".join(reversed((t or "").split()))) for q, t in queries]
    built = index.build(documents(spark, rows))
    parsed = retrieval.parse_queries(spark.createDataFrame(queries, "query_id int, text string"))
    stored = store.save(built, str(tmp_path / "i"))
    monkeypatch.setattr(blocks, "MAX_QUERY_TERMS", 3)
    monkeypatch.setattr(bulk, "BLOCK", 64)
    monkeypatch.setattr(bulk, "CELLS", 2000)
    for name in ("daat_join", "maxscore_join"):
        monkeypatch.setattr(retrieval, name, None)
    rank = lambda df: {(r["query_id"], r["rank"], r["doc_id"]) for r in df.collect()}
    for conjunctive in (False, True):
        want = brute(rows, queries, scoring, 7, conjunctive)
        for at in (built, stored):
            found = retrieval.daat(at, parsed, scoring, 7, conjunctive)
            assert found.schema["query_id"].dataType.simpleString() == "int" and found.columns == ["query_id", "rank", "doc_id", "score"]
            assert rank(found) == want
        assert rank(retrieval.maxscore(built, parsed, scoring, 7, conjunctive)) == want


def test_ties_in_large_query_sets(spark, monkeypatch):
    """TF-IDF gives many documents the same score: the smallest ids win, also where their blocks come last."""
    from tessera.operators import blocks, bulk

    monkeypatch.setattr(blocks, "MAX_QUERY_TERMS", 1)
    monkeypatch.setattr(bulk, "BLOCK", 16)
    monkeypatch.setattr(retrieval, "daat_join", None)
    rows = [(i, str(i), "mast " + "oar " * (i % 3 == 0) + f"w{i} " * (200 - i)) for i in range(200)]
    parsed = retrieval.parse_queries(spark.createDataFrame([(1, "mast oar"), (2, "oar mast"), (3, "oar")], "query_id int, text string"))
    found = {(r["query_id"], r["rank"], r["doc_id"]) for r in retrieval.daat(index.build(documents(spark, rows)), parsed, "tfidf", 5).collect()}
    assert found == {(q, i + 1, 3 * i) for q in (1, 2, 3) for i in range(5)}


@pytest.mark.parametrize("how", ["stemmed", "maxscore", "facade", "ln"])
def test_every_way_in_takes_large_query_sets(spark, how, monkeypatch):
    """Stemming, pruning, the facade and the natural logarithm over a large query set: the rows of the join plan, without it."""
    from tessera.operators import blocks

    stops, stem = (["the"], True) if how == "stemmed" else (None, False)
    rows = [(i, f"d{i}", " ".join(["the rowing boats"] * (i % 3 + 1) + [f"harbour{i % 7}s"] * (i % 5) + ["ferries"] * (i % 2))) for i in range(60)]
    topics = spark.createDataFrame([(1, "the boat row"), (2, "boats harbour3s ferries"), (3, "ferries harbour3s the"), (4, "none")], "query_id int, text string")
    built = index.build(documents(spark, rows), stops, stem)
    parsed = retrieval.parse_queries(topics, stops, stem)
    scoring, more = ("tfidf" if how == "maxscore" else "bm25"), {"tf_log": "ln"} if how == "ln" else {}
    want = {tuple(r) for r in retrieval.daat_join(built, parsed, scoring, 7, **more).collect()}
    monkeypatch.setattr(blocks, "MAX_QUERY_TERMS", 2)
    for name in ("daat_join", "maxscore_join"):
        monkeypatch.setattr(retrieval, name, None)
    if how == "facade":
        found = SearchEngine(built).search_batch(topics, k=7)
        assert all(r["doc_no"] == f"d{r['doc_id']}" for r in found.collect())
        found = found.drop("doc_no")
    else:
        found = retrieval.search(built, parsed, scoring, "maxscore" if how == "maxscore" else "daat", 7, **more)
    assert {tuple(r) for r in found.select("query_id", "rank", "doc_id", "score").collect()} == want and want


def _scorer(queries: int, k: int):
    from tessera.operators import bulk

    share = bulk._Share(np.arange(queries), [(np.arange(queries), np.zeros((queries, 1), np.int64))], np.ones(1), np.arange(5.0), 1.0, False, 1000.0)
    return bulk._Scorer(share, k, False)


def test_hits_are_put_into_their_places(monkeypatch):
    """None, some and many hits of a query at a time, with equal scores: the k best, the smaller document first."""
    from tessera.operators import bulk

    monkeypatch.setattr(bulk, "ROUNDS", 3)
    rng = np.random.default_rng(5)
    for k in (1, 4):
        scorer, seen, doc = _scorer(6, k), {q: [] for q in range(6)}, 0
        scorer._merge(*(np.zeros(0, kind) for kind in (np.int64, np.float64, np.int64)))
        for many in (1, 4, 40, 7, 2):
            query, score = rng.integers(0, 6, many), rng.integers(0, 4, many) / 2
            docs = rng.permutation(1000)[:many] * 8 + doc
            doc += 1
            scorer._merge(query, score, docs)
            for q, s, d in zip(query, score, docs):
                seen[int(q)].append((-s, d))
            for q, rows in seen.items():
                want = sorted(rows)[:k]
                assert [(-s, d) for s, d in zip(scorer.score[q], scorer.doc[q]) if d != bulk._NONE] == want


def test_little_is_weighed_at_once(monkeypatch):
    """The first block can matter to every query: its documents are weighed in parts of bounded size."""
    from types import SimpleNamespace

    from tessera.operators import bulk

    sizes = []

    def searchsorted(a, v, *more, **named):
        sizes.append(np.size(v))
        return np.searchsorted(a, v, *more, **named)

    monkeypatch.setattr(bulk, "np", SimpleNamespace(**{**vars(np), "searchsorted": searchsorted}))
    monkeypatch.setattr(bulk, "SUMS", 16)
    scorer, docs = _scorer(50, 10), np.arange(20)
    scorer.block(docs, np.ones(20), docs, np.zeros(20, np.int64), np.full(20, 2))
    assert (scorer.doc == np.arange(10)).all() and max(sizes) <= 64


def test_large_query_sets_are_analysed_once(spark, monkeypatch):
    """What the evaluation reads again and again is a stored table of the terms, not the texts."""
    from tessera.operators import blocks, bulk

    plans = []
    evaluate = bulk.evaluate

    def looked_at(index_, queries, *how):
        plans.append(queries._jdf.queryExecution().optimizedPlan().toString())
        return evaluate(index_, queries, *how)

    monkeypatch.setattr(blocks, "MAX_QUERY_TERMS", 1)
    monkeypatch.setattr(bulk, "evaluate", looked_at)
    built = index.build(documents(spark, [(i, f"d{i}", "mast oar" if i % 2 else "oar") for i in range(6)]))
    parsed = retrieval.parse_queries(spark.createDataFrame([(1, "mast\toar"), (2, "oar")], "query_id int, text string"))
    found = [(r["query_id"], r["doc_id"]) for r in retrieval.daat(built, parsed, "tfidf", 2).orderBy("query_id", "rank").collect()]
    assert found == [(1, 1), (1, 3), (2, 0), (2, 1)]
    assert len(plans) == 1 and "regexp" not in plans[0] and "split" not in plans[0]


def test_very_short_documents_are_read_last(spark):
    """They hold too little of a query to tell what its k best documents reach; the others come by length."""
    from dataclasses import replace

    import pyarrow as pa

    from tessera.operators import bulk

    built = index.build(documents(spark, [(i, f"d{i}", "oar " * n) for i, n in enumerate([9, 1, 30, 2, 8, 10])]))  # ten on average
    numbers = spark.createDataFrame([("oar", 0)], "term string, number int")
    by_length = lambda short: [
        [r["doc_len"] for r in part] for part in bulk._documents(replace(built, docs=built.docs.coalesce(1)), pa.array(["oar"]), numbers, short).rdd.glom().collect() if part
    ]
    assert by_length(True) == [[8, 9, 10, 30, 1, 2]]
    assert by_length(False) == [[30, 10, 9, 8, 2, 1]]
