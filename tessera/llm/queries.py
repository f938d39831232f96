"""Queries of the training-data problems, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import frequency, mojibake, neardup, packing, sentences, tokenizer, topn
from tessera.plans.lineage import cut

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


_FREQUENCIES = (
    "WITH f AS (SELECT rtrim(term, ' ') AS term, count(DISTINCT doc_id) AS df, sum(coalesce(tf, 0))::BIGINT AS cf FROM postings WHERE term IS NOT NULL GROUP BY 1), "
    "m AS (SELECT term, df, cf, CASE WHEN df < 3 THEN 'rare' WHEN df * 100 > 40 * (SELECT count(DISTINCT doc_id) FROM doc_index) THEN 'common' END AS mark FROM f) "
)


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.marked(frequency.term_frequencies(table(spark, sf_dir, "postings")), table(spark, sf_dir, "doc_index"))


@query(_FREQUENCIES + "SELECT term, mark FROM m WHERE mark IS NOT NULL")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).filter(F.col("mark").isNotNull()).select("term", "mark")


@query(_FREQUENCIES + "SELECT term, df, cf, mark FROM m")
def p1_term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir)


_TOP = (
    "SELECT query_id, doc_id{more} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, "
    "max(score) AS score FROM hits WHERE doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY query_id, doc_id)) WHERE rank <= 10"
)


@query(_TOP.format(more=""))
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_n(table(spark, sf_dir, "hits"), "query_id", "doc_id", "score", 10).select("query_id", "doc_id")


@query(_TOP.format(more=", score, rank::INTEGER AS rank"))
def p2_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_n(table(spark, sf_dir, "hits"), "query_id", "doc_id", "score", 10).select("query_id", "doc_id", "score", "rank")


def _damage(spark: SparkSession, sf_dir: str, restoring: bool) -> DataFrame:
    """Both tables against one model: counted on the whole corpus, adapted on all of either table."""
    passages, topics = table(spark, sf_dir, "passages"), table(spark, sf_dir, "topics")
    model = mojibake.train((table(spark, sf_dir, "documents"), "text", "doc_id"), [(passages, "text", "doc_no"), (topics, "text", "query_id")])
    of = lambda rows, key, name: mojibake.damaged(rows, key, "text", model, restoring).withColumn("tbl", F.lit(name))
    both = of(passages.withColumn("doc_no", F.rtrim("doc_no")), "doc_no", "passages").unionByName(of(topics, "query_id", "topics"))
    return both.filter(F.col("key").isNotNull()).withColumnRenamed("key", "rec_key")


@query()
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _damage(spark, sf_dir, False).select("tbl", "rec_key").distinct()


@query()
def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _damage(spark, sf_dir, True).select("tbl", "rec_key", "damage", "restored", "complete").distinct()


#: Whole words, similarity 0.7, at least ten distinct words.
WORDS = neardup.Banding(threshold=0.7, shingle=1, min_size=10)

_WORDS = (
    "WITH w AS (SELECT DISTINCT rtrim(doc_no, ' ') AS doc_no, list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), "
    "'[!-/:-@\\[-`{-~]', '', 'g'), '[ \\t\\r\\n]+'), lambda x: x <> ''))) AS ws FROM passages WHERE text IS NOT NULL), "
    "s AS (SELECT doc_no, ws, len(ws) AS n FROM w WHERE len(ws) >= 10), u AS (SELECT doc_no, n, hash(ws) AS h, unnest(ws) AS x FROM s), "
    "p AS (SELECT a.doc_no AS doc_no_a, b.doc_no AS doc_no_b, count(*) / (a.n + b.n - count(*))::DOUBLE AS j FROM u a JOIN u b ON a.x = b.x AND a.doc_no < b.doc_no "
    "GROUP BY a.doc_no, b.doc_no, a.h, b.h, a.n, b.n) SELECT DISTINCT doc_no_a, doc_no_b FROM p WHERE j >= 0.7 - 1e-12"
)


@query(_WORDS)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neardup.record_pairs(neardup.near_duplicates(table(spark, sf_dir, "passages"), "doc_no", "text", WORDS))
    return pairs.select(F.col("key_a").alias("doc_no_a"), F.col("key_b").alias("doc_no_b"))


# groups by following links to and fro; links as the pairs say. A document number with one text only
_GROUPS = _WORDS.replace("WITH w AS", "WITH RECURSIVE w AS").replace("SELECT DISTINCT doc_no_a", ", l AS (SELECT DISTINCT doc_no_a") + (
    "), e AS (SELECT doc_no_a AS x, doc_no_b AS y FROM l UNION ALL SELECT doc_no_b, doc_no_a FROM l), "
    "r AS (SELECT DISTINCT x, x AS y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), "
    "g AS (SELECT x, min(y) AS least FROM r GROUP BY x), d AS (SELECT x, count(*) AS n FROM e GROUP BY x), "
    "k AS (SELECT DISTINCT rtrim(doc_no, ' ') AS doc_no FROM passages WHERE doc_no IS NOT NULL) "
    "SELECT k.doc_no, coalesce(g.least, k.doc_no) AS group_doc_no, coalesce(d.n, 0)::BIGINT AS links FROM k LEFT JOIN g ON g.x = k.doc_no LEFT JOIN d ON d.x = k.doc_no"
)


@query(_GROUPS)
def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = table(spark, sf_dir, "passages")
    found = neardup.near_duplicates(passages, "doc_no", "text", WORDS)
    kept = neardup.NearDuplicates(cut(found.members), cut(found.links))
    groups = neardup.record_groups(kept, passages, "doc_no")
    return groups.select(F.col("key").alias("doc_no"), F.col("group_key").alias("group_doc_no"), "links")


@query()
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.token_ids(table(spark, sf_dir, "documents"))


@query()
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokenizer.token_counts(table(spark, sf_dir, "documents")))


@query("SELECT count(*) FILTER (length(text) > 0) AS documents, 0::BIGINT AS over_full, 0::BIGINT AS with_gaps, 0::BIGINT AS divided_short, 0::BIGINT AS missing_numbers FROM documents")
def p7_containers_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every packing must keep: each document with tokens is there with all its parts, no container is over-full or has
    a gap between its items, no document that fits is divided, and containers are numbered without gaps."""
    return packing.checks(packing.pack(tokenizer.token_counts(table(spark, sf_dir, "documents"))))


@query()
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return sentences.sentences(documents, sentences.fit(documents))
