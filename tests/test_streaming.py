from tessera.operators import index
from tessera.streaming import ingest

SCHEMA = "doc_id long, doc_no string, text string"


def test_batches_merge_to_the_whole(spark, tmp_path):
    rows = [(i, f"d{i}", f"common w{i % 3} w{i}") for i in range(20)] + [(20, "e", None)]
    for n, part in enumerate((rows[:7], rows[7:8], rows[8:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    path = str(tmp_path / "index")
    ingest.start(stream(), path, str(tmp_path / "state")).awaitTermination()
    ingest.start(stream(), path, str(tmp_path / "state")).awaitTermination()  # nothing new
    got, want = ingest.merged(spark, path), index.build(spark.createDataFrame(rows, SCHEMA))
    assert got.stats == want.stats
    for a, b in ((got.postings, want.postings), (got.lexicon, want.lexicon), (got.doc_index, want.doc_index)):
        assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}


def test_a_batch_done_again_replaces_itself(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "x y")], SCHEMA)
    for _ in range(2):
        ingest.append(docs, str(tmp_path), 0)
    assert ingest.merged(spark, str(tmp_path)).postings.count() == 2


def test_merged_lexicons(spark):
    rows = [(0, "a ", 2, 0.5, None), (0, "a", 2, 0.7, 0.1), (1, "a", None, None, 0.4), (1, "b", 600, 0.1, 0.2), (2, None, 3, 1.0, 1.0)]
    merged = index.merge_lexicons(spark.createDataFrame(rows, "spimi_block int, term string, df int, max_tfidf double, max_bm25 double"))
    assert {tuple(r) for r in merged.collect()} == {("a", 2, 1, 0.7, 0.4), ("b", 600, 25, 0.1, 0.2)}


def test_compaction(spark, tmp_path):
    for n in range(3):
        ingest.append(spark.createDataFrame([(n, f"d{n}", f"x y{n}")], SCHEMA), str(tmp_path / "in"), n)
    whole = ingest.compact(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert {tuple(r) for r in whole.postings.collect()} == {tuple(r) for r in ingest.merged(spark, str(tmp_path / "in")).postings.collect()}
    assert whole.stats.num_docs == 3 and whole.stats.num_terms == 4
