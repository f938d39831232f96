"""Registered queries over the test tables, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import codec, text
from tessera.functions.stopwords import ENGLISH
from tessera.operators import evaluate, index, ranking, retrieval, tree
from tessera.plans.engine import SearchEngine
from tessera.plans.lineage import cut, fresh_folder
from tessera.sources import collection, store
from tessera.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.spread(table(spark, sf_dir, "documents").select("doc_id", "doc_no", "text"))


def _index(spark: SparkSession, sf_dir: str, **how) -> index.Index:
    return index.build(_documents(spark, sf_dir), **how)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.blocks_of(index.postings_of(cut(index.analysed(_documents(spark, sf_dir)))))


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "topics")


_CLEAN = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^\x00-\x7F]+', ' ', 'g'), "
    r"'<[^>]+>|#\w+|[^\w\s]|_|@\w+|https*://\S+|www.\S+', ' ', 'g'), '\s+', ' ', 'g'))"
)
_TOKENS = "list_filter(string_split(coalesce(" + _CLEAN + ", ''), ' '), lambda t: t <> '')"
_DOCS = f"docs AS (SELECT doc_id, rtrim(doc_no, ' ') AS doc_no, {_TOKENS.format('text')} AS tokens FROM documents)"
_POSTINGS = (
    _DOCS + ", post AS (SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf, max(dl) AS dl FROM "
    "(SELECT doc_id, len(tokens) AS dl, unnest(list_transform(tokens, lambda t: t[1:30])) AS term FROM docs) GROUP BY term, doc_id), "
    "st AS (SELECT count(*)::DOUBLE AS n, sum(len(tokens))::DOUBLE AS s, sum(len(tokens))::DOUBLE / count(*) AS avgdl FROM docs), "
    "lex AS (SELECT term, count(*) AS df, max(tf) AS max_tf, log10(max(n) / count(*)) AS idf FROM post, st GROUP BY term)"
)
_BM25 = "idf * (1 + {log}(tf)) / (1 + {log}(tf) + 1.6 * (0.25 + 0.75 * dl / avgdl))"
_TFIDF = "(1 + log10(tf)) * idf"
_QTERMS = f"q AS (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS n_terms FROM (SELECT DISTINCT query_id, unnest({_TOKENS.format('text')}) AS term FROM topics))"


def _search_sql(weight: str, conjunctive: bool = False, numbered: bool = False) -> str:
    extra, more = ("doc_no, ", " JOIN docs USING (doc_id)") if numbered else ("", "")
    having = " HAVING count(*) = max(n_terms)" if conjunctive else ""
    return (
        f"WITH {_POSTINGS}, {_QTERMS}, s AS (SELECT query_id, doc_id, round(sum({weight}), 9) AS score FROM q JOIN lex USING (term) "
        f"JOIN post USING (term), st GROUP BY query_id, doc_id{having}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id "
        f"ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, rank::INTEGER AS rank, doc_id, {extra}round(score, 6) AS score FROM r{more} WHERE rank <= 10"
    )


def _searched(spark: SparkSession, sf_dir: str, scoring: str, algorithm: str = "daat", conjunctive: bool = False, **how) -> DataFrame:
    queries = retrieval.parse_queries(_topics(spark, sf_dir))
    found = retrieval.search(_index(spark, sf_dir), queries, scoring, algorithm, 10, conjunctive, **how)
    return found.withColumn("score", F.round("score", 6))


@query(f"SELECT doc_id, {_CLEAN.format('text')} AS cleaned FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, array_to_string({_TOKENS.format('text')}, '|') AS tokens, len({_TOKENS.format('text')})::INTEGER AS doc_len FROM documents")
def tokenize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = index.analysed(_documents(spark, sf_dir))
    return docs.select("doc_id", F.array_join("tokens", "|").alias("tokens"), "doc_len")


@query(
    f"SELECT doc_id, array_to_string(list_filter({_TOKENS.format('text')}, lambda t: NOT list_contains(["
    + ", ".join(f"'{w}'" for w in sorted(ENGLISH))
    + "], t)), ' ') AS kept FROM documents"
)
def stopword_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = text.tokens(F.col("text"), sorted(ENGLISH))
    return _documents(spark, sf_dir).select("doc_id", F.array_join(kept, " ").alias("kept"))


@query(f"WITH {_POSTINGS} SELECT term, doc_id, tf, dl::INTEGER AS doc_len FROM post")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings_of(index.analysed(_documents(spark, sf_dir)))


@query(f"WITH {_DOCS} SELECT doc_id, doc_no, len(tokens)::INTEGER AS doc_len FROM docs")
def doc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.analysed(_documents(spark, sf_dir)).select("doc_id", "doc_no", "doc_len")


@query(f"WITH {_POSTINGS} SELECT n::BIGINT AS num_docs, s::BIGINT AS sum_len, (SELECT count(*) FROM lex) AS num_terms, round(avgdl, 6) AS avgdl FROM st")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = _index(spark, sf_dir)
    return built.lexicon.agg(F.count(F.lit(1)).alias("num_terms")).select(
        F.lit(built.stats.num_docs).cast("long").alias("num_docs"), F.lit(built.stats.sum_len).cast("long").alias("sum_len"),
        "num_terms", F.round(F.lit(built.stats.avgdl), 6).alias("avgdl"),
    )


@query(
    f"WITH {_POSTINGS}, b AS (SELECT term, max_by(tf, r) AS btf, max_by(dl, r) AS bdl FROM (SELECT *, row_number() OVER "
    "(PARTITION BY term ORDER BY tf / dl::DOUBLE, doc_id DESC) AS r FROM post) GROUP BY term), "
    f"u AS (SELECT term, max({_BM25.format(log='log10')}) AS ub FROM post JOIN lex USING (term), st GROUP BY term) "
    "SELECT term, df, max_tf, CASE WHEN df < 512 THEN 1 ELSE ceil(sqrt(df)) END::INTEGER AS num_blocks, round(idf, 6) AS idf, "
    "round((1 + log10(max_tf)) * idf, 6) AS max_tfidf, round(idf * btf / (btf + 1.6 * (0.25 + 0.75 * bdl / avgdl)), 6) AS max_bm25, "
    "round(ub, 6) AS ub_bm25_safe FROM lex JOIN b USING (term) JOIN u USING (term), st"
)
def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = _index(spark, sf_dir).lexicon
    return lex.select("term", "df", "max_tf", "num_blocks", *[F.round(c, 6).alias(c) for c in ("idf", "max_tfidf", "max_bm25", "ub_bm25_safe")])


_BLOCKS = (
    f"WITH {_POSTINGS}, r AS (SELECT term, doc_id, tf, df, CASE WHEN df < 512 THEN 1 ELSE ceil(sqrt(df)) END AS nb, "
    "row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1 AS rn FROM post JOIN lex USING (term)), "
    "bl AS (SELECT term, floor(rn / ceil(df / nb))::INTEGER AS block_no, count(*)::INTEGER AS nr_postings, min(doc_id) AS min_doc_id, "
    "max(doc_id) AS max_doc_id, array_to_string(list(doc_id ORDER BY doc_id), ' ') AS doc_ids FROM r GROUP BY ALL) "
)


@query(_BLOCKS + "SELECT * FROM bl")
def posting_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    return blocks.select("term", "block_no", "nr_postings", "min_doc_id", "max_doc_id", F.array_join("doc_ids", " ").alias("doc_ids"))


@query(
    _BLOCKS.rstrip() + f", {_QTERMS}, t AS (SELECT DISTINCT term, CAST(query_id % 1000 AS BIGINT) AS target FROM q) "
    "SELECT term, target, min(doc_id) AS doc_id, arg_min(tf, doc_id) AS tf FROM t JOIN post USING (term) WHERE doc_id >= target GROUP BY term, target"
)
def next_geq(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = retrieval.parse_queries(_topics(spark, sf_dir)).select("term", (F.col("query_id") % 1000).cast("long").alias("target"))
    return retrieval.next_geq(_blocks(spark, sf_dir), targets)


@query(
    _BLOCKS + "SELECT term, block_no, array_to_string(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i = 1 THEN 1 ELSE l[i] - l[i - 1] END), ' ') AS gaps "
    "FROM (SELECT term, block_no, list_transform(string_split(doc_ids, ' '), lambda x: CAST(x AS BIGINT)) AS l FROM bl)"
)
def dgap(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    return blocks.select("term", "block_no", F.array_join(codec.gaps(F.col("doc_ids")), " ").alias("gaps"))


@query(_BLOCKS + "SELECT term, block_no, nr_postings, TRUE AS same FROM bl")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block through the gap, variable-byte and unary codecs and back."""
    b = _blocks(spark, sf_dir)
    coded = b.withColumn("d", codec.encode_gaps(F.col("doc_ids"))).withColumn("f", codec.encode_unary(F.col("tfs")))
    back = coded.withColumn("d2", codec.decode_gaps(F.col("d"), F.col("min_doc_id"))).withColumn("f2", codec.decode_unary(F.col("f"), F.col("nr_postings")))
    same = (F.col("d2") == F.col("doc_ids")) & (F.col("f2") == F.col("tfs").cast("array<bigint>"))
    return back.select("term", "block_no", "nr_postings", same.alias("same"))


@query(f"WITH {_POSTINGS}, {_QTERMS} SELECT term, df, max_tf FROM lex WHERE term IN (SELECT term FROM q)")
def lookup_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.lookup(_index(spark, sf_dir).lexicon, retrieval.parse_queries(_topics(spark, sf_dir)))
    return found.select("term", "df", "max_tf")


@query(f"WITH {_POSTINGS} SELECT term, df FROM lex ORDER BY df DESC, term LIMIT 10")
def top_df_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.top_df_terms(_index(spark, sf_dir).lexicon, 10)


@query(f"WITH {_POSTINGS} SELECT df, count(*) AS terms FROM lex GROUP BY df")
def df_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.df_histogram(_index(spark, sf_dir).lexicon)


@query(_search_sql(_TFIDF))
def tfidf_disjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "tfidf")


@query(_search_sql(_BM25.format(log="log10")))
def bm25_disjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "bm25")


@query(_search_sql(_BM25.format(log="ln")))
def bm25_ln_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "bm25", tf_log="ln")


@query(_search_sql(_TFIDF, True))
def tfidf_conjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "tfidf", conjunctive=True)


@query(_search_sql(_BM25.format(log="log10"), True))
def bm25_conjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "bm25", conjunctive=True)


@query(_search_sql(_TFIDF))
def maxscore_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "tfidf", "maxscore")


@query(_search_sql(_BM25.format(log="log10")))
def maxscore_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "bm25", "maxscore")


@query()
def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop words removed and tokens stemmed on both sides (SQL has no stemmer)."""
    stops = sorted(ENGLISH)
    built = _index(spark, sf_dir, stop_words=stops, stem=True)
    found = retrieval.daat(built, retrieval.parse_queries(_topics(spark, sf_dir), stops, True))
    return found.withColumn("score", F.round("score", 6))


_RUN = (
    "run AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, "
    "max(score) AS s FROM hits WHERE doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY query_id, doc_id)), "
    "qr AS (SELECT query_id, doc_id, max(coalesce(relevance, 0)) AS rel FROM qrels GROUP BY query_id, doc_id)"
)


def _metrics_sql(variant: str, dcg: str) -> str:
    shown = "least(10, judged)" if variant == "judged" else "10"
    p = "CASE WHEN hit = 1 THEN p_at ELSE 0 END" if variant == "judged" else "p_at"
    disc = "rank" if dcg == "rank" else "10"
    return (
        f"WITH {_RUN}, tot AS (SELECT query_id, count(*) AS judged, count(*) FILTER (rel > 0) AS relevant FROM qr GROUP BY query_id), "
        "seen AS (SELECT query_id, rank, coalesce(rel, 0) AS rel, CASE WHEN rel > 0 THEN 1 ELSE 0 END AS hit FROM run LEFT JOIN qr USING (query_id, doc_id) "
        "WHERE rank <= 10), cum AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) / rank::DOUBLE AS p_at FROM seen), "
        f"per AS (SELECT query_id, sum(hit) AS hits, count(*) AS returned, sum({p}) AS p_sum, sum(rel / greatest(1.0, ln({disc}) / ln(10.0))) AS dcg FROM cum GROUP BY query_id), "
        f"m AS (SELECT query_id, coalesce(hits, 0) / {shown}::DOUBLE AS precision, CASE WHEN relevant > 0 THEN coalesce(hits, 0) / relevant::DOUBLE ELSE 0 END AS recall, "
        "coalesce(p_sum / returned, 0) AS average_precision, coalesce(per.dcg, 0) AS dcg FROM tot LEFT JOIN per USING (query_id)) "
    )


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hits = table(spark, sf_dir, "hits").filter("doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    best = hits.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    ranked = ranking.top_k(best, "query_id", "score", "doc_id", 10)
    judgments = evaluate.unique_judgments(table(spark, sf_dir, "qrels"), ["relevance"])
    return ranked, judgments


_MEASURES = ("precision", "recall", "average_precision", "dcg")
_ROUNDED = "SELECT query_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _MEASURES) + " FROM m"


@query(_metrics_sql("judged", "rank") + _ROUNDED)
def metrics_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(*_run(spark, sf_dir)).select("query_id", *[F.round(c, 6).alias(c) for c in _MEASURES])


@query(_metrics_sql("plain", "constant") + _ROUNDED)
def metrics_plain_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.metrics(*_run(spark, sf_dir), variant="plain", dcg="constant")
    return found.select("query_id", *[F.round(c, 6).alias(c) for c in _MEASURES])


@query(
    _metrics_sql("judged", "rank") + "SELECT count(*) AS queries, round(avg(average_precision), 6) AS map, round(avg(precision), 6) AS mean_precision, "
    "round(avg(recall), 6) AS mean_recall, round(avg(dcg), 6) AS mean_dcg, round(stddev_pop(dcg), 6) AS std_dcg FROM m"
)
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.summary(evaluate.metrics(*_run(spark, sf_dir)))
    return found.select("queries", *[F.round(c, 6).alias(c) for c in ("map", "mean_precision", "mean_recall", "mean_dcg", "std_dcg")])


@query(
    "WITH o AS (SELECT spimi_block, rtrim(term, ' ') AS term, df, max(max_tfidf) AS t, max(max_bm25) AS b FROM lexicon WHERE term IS NOT NULL GROUP BY 1, 2, 3), "
    "m AS (SELECT term, sum(coalesce(df, 0))::BIGINT AS df, max(t) AS max_tfidf, max(b) AS max_bm25 FROM o GROUP BY term) "
    "SELECT term, df, CASE WHEN df < 512 THEN 1 ELSE ceil(sqrt(df)) END::INTEGER AS num_blocks, max_tfidf, max_bm25 FROM m"
)
def merged_lexicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.merge_lexicons(table(spark, sf_dir, "lexicon"))


@query(
    "SELECT p.term, p.doc_id, p.tf, d.doc_len FROM (SELECT rtrim(term, ' ') AS term, doc_id, max(coalesce(tf, 0)) AS tf FROM postings WHERE term IS NOT NULL "
    "GROUP BY 1, 2) p LEFT JOIN (SELECT doc_id, max(doc_len) AS doc_len FROM doc_index GROUP BY doc_id) d USING (doc_id)"
)
def posting_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.with_lengths(table(spark, sf_dir, "postings"), table(spark, sf_dir, "doc_index"))


@query(_search_sql(_BM25.format(log="log10"), numbered=True))
def engine_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facade, with document numbers."""
    engine = SearchEngine(_index(spark, sf_dir))
    return engine.search_batch(_topics(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH {_POSTINGS} SELECT term, df, max_tf, round(idf, 6) AS idf FROM lex")
def streamed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents fed as a stream of one file, merged; equal to the index built at once."""
    path = fresh_folder(spark, "streamed")
    stream = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parquet*")
    ingest.start(stream.select("doc_id", "doc_no", "text"), path, f"{path}-state").awaitTermination()
    return ingest.merged(spark, path).lexicon.select("term", "df", "max_tf", F.round("idf", 6).alias("idf"))


@query(f"WITH {_DOCS} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, doc_no, array_to_string(tokens, ' ') AS text FROM docs WHERE doc_no <> ''")
def read_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as compressed collection files, read back with document ids in the order of the lines. Documents without
    a number are no lines of a collection."""
    docs = index.analysed(_documents(spark, sf_dir)).select("doc_id", "doc_no", F.array_join("tokens", " ").alias("text"))
    path = fresh_folder(spark, "collection")
    collection.write_collection(docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), path)
    return collection.read_collection(spark, path, numbered=True)


@query(_search_sql(_BM25.format(log="log10")).replace("FROM topics)", "FROM topics WHERE query_id % 50 = 0)"))
def stored_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics whose id is divisible by 50, pruned, over an index that was saved and loaded again."""
    stored = store.save(_index(spark, sf_dir), fresh_folder(spark, "index"))
    queries = retrieval.parse_queries(_topics(spark, sf_dir).filter("query_id % 50 = 0"))
    return retrieval.maxscore(stored, queries).withColumn("score", F.round("score", 6))


@query(_BLOCKS + "SELECT term || ' ' || array_to_string(list(doc_id || ':' || tf ORDER BY doc_id), ' ') AS value FROM (SELECT *, floor(rn / ceil(df / nb)) AS b FROM r) GROUP BY term, b")
def stored_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting blocks saved with the index, loaded and rendered as text."""
    path = fresh_folder(spark, "index")
    store.save(_index(spark, sf_dir), path, blocks=True)
    return store.render_postings(store.load_blocks(spark, path))


@query(f"WITH {_POSTINGS} SELECT count(*) AS terms, sum(df)::BIGINT AS postings, round(avg(df), 6) AS mean, round(sum(df * df) / sum(df)::DOUBLE, 6) AS weighted_mean, max(df) AS longest FROM lex")
def list_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.list_lengths(_index(spark, sf_dir).lexicon)
    return found.select("terms", "postings", F.round("mean", 6).alias("mean"), F.round("weighted_mean", 6).alias("weighted_mean"), "longest")


_P3 = (
    "WITH p AS (SELECT rtrim(term, ' ') AS term, count(DISTINCT doc_id) AS n_docs FROM postings WHERE term IS NOT NULL GROUP BY 1), "
    "l AS (SELECT term, sum(coalesce(df, 0))::BIGINT AS lexicon_df FROM (SELECT DISTINCT spimi_block, rtrim(term, ' ') AS term, df FROM lexicon "
    "WHERE term IS NOT NULL) GROUP BY term), j AS (SELECT term, coalesce(n_docs, 0) AS n_docs, coalesce(lexicon_df, 0) AS lexicon_df FROM p FULL JOIN l USING (term)) "
)


@query(_P3 + "SELECT term FROM j WHERE n_docs <> lexicon_df")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = tree.term_documents(table(spark, sf_dir, "postings"), table(spark, sf_dir, "lexicon"))
    return both.filter(F.col("n_docs") != F.col("lexicon_df")).select("term")


@query(_P3 + "SELECT * FROM j")
def p3_term_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.term_documents(table(spark, sf_dir, "postings"), table(spark, sf_dir, "lexicon"))
