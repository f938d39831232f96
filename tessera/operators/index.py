"""Inverted index as DataFrames: document index, postings, lexicon, posting blocks, collection statistics.

Settled points: every document is kept, also an empty one (length 0, counted in N and the average length); terms are cut
to 30 characters before counting, so two long terms of one document that share the cut form are one posting; postings
are always in ascending doc_id; statistics are always computed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scoring, text
from tessera.operators.heavy import heavy_keys
from tessera.operators.ranking import chunked_row_number
from tessera.plans.lineage import cut

#: Below this document frequency a list is one block; from it on there are ceil(sqrt(df)) blocks (fixed rule).
SINGLE_BLOCK_BELOW = 512
#: Documents a rank chunk spans, and postings from which a term may be ranked in chunks.
RANK_CHUNK = 1 << 20


@dataclass(frozen=True)
class Stats:
    """Collection statistics. ``avgdl`` is 0 for an empty collection."""

    num_docs: int
    sum_len: int
    num_terms: int | None = None

    @property
    def avgdl(self) -> float:
        return self.sum_len / self.num_docs if self.num_docs else 0.0


@dataclass(frozen=True)
class Index:
    """``docs``: the analysed rows (doc_id, tokens, doc_len), where the index still has them."""

    doc_index: DataFrame
    postings: DataFrame
    lexicon: DataFrame
    stats: Stats
    docs: DataFrame | None = None


def analysed(documents: DataFrame, stop_words: Sequence[str] | None = None, stem: bool = False) -> DataFrame:
    """doc_id, doc_no, tokens, doc_len. A null text has no tokens; doc_no loses its padding blanks."""
    return documents.select(
        "doc_id", F.rtrim("doc_no").alias("doc_no"), text.tokens(F.col("text"), stop_words, stem).alias("tokens")
    ).withColumn("doc_len", F.size("tokens"))


def postings_of(docs: DataFrame) -> DataFrame:
    """term, doc_id, tf, doc_len. Counting happens within the row's sorted token array: no shuffle by (doc, term)."""
    ordered = docs.select("doc_id", "doc_len", F.array_sort(F.transform("tokens", text.index_term)).alias("s"))
    # no filter on empty arrays: it would be pushed below and clean every text twice; inline drops null arrays
    first = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    starts = ordered.withColumn("b", F.when(F.size("s") > 0, first))
    runs = F.transform("b", lambda p, k: F.struct(F.get("s", p).alias("term"), (F.coalesce(F.get("b", k + 1), F.size("s")) - p).alias("tf")))
    return starts.select("doc_id", "doc_len", F.inline(runs)).select("term", "doc_id", "tf", "doc_len")


def block_count(df: Column) -> Column:
    return F.when(df < SINGLE_BLOCK_BELOW, F.lit(1)).otherwise(F.ceil(F.sqrt(df.cast("double")))).cast("int")


def collection_stats(doc_index: DataFrame) -> Stats:
    row = doc_index.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("s")).first()
    return Stats(row["n"], row["s"])


def lexicon_of(postings: DataFrame, stats: Stats) -> DataFrame:
    """One row a term: df, max_tf, idf, exact TF-IDF bound, stored BM25 figure, safe BM25 bound, number of blocks.

    One hash aggregation with map-side combine, so a frequent term reaches its reducer as one row a map task. The
    posting with the largest tf/doc_len (the smaller doc_id of equal ones) gives the stored ``max_bm25``; it is found by
    one packed decimal, ratio before document, which a hash buffer can hold. The safe bound is the largest actual
    weight and is the only one used for pruning.
    """
    n, avgdl = F.lit(stats.num_docs), F.lit(stats.avgdl)
    shape = scoring.bm25(F.col("tf"), F.lit(1.0), F.col("doc_len"), avgdl)
    # 19 digits each: the ratio, which is at most 1 (times 10^18), and how far the doc_id is from the largest possible
    ratio = (F.col("tf") / F.col("doc_len") * F.lit(1e18)).cast("decimal(19,0)")
    place = (ratio * F.lit("10000000000000000000").cast("decimal(20,0)") + (F.lit(2**63 - 1) - F.col("doc_id")).cast("decimal(19,0)")).cast("decimal(38,0)")
    tf_and_len = F.shiftleft(F.col("tf").cast("long"), 32) + F.col("doc_len")
    best_tf, best_len = F.shiftright("best", 32).cast("int"), F.col("best").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return (
        postings.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"), F.max_by(tf_and_len, place).alias("best"), F.max(shape).alias("shape"))
        .withColumn("idf", scoring.idf(F.col("df"), n)).withColumn("bm25_tf", best_tf).withColumn("bm25_dl", best_len)
        .select(
            "term", "df", "max_tf", "idf", block_count(F.col("df")).alias("num_blocks"), "bm25_tf", "bm25_dl",
            scoring.tfidf(F.col("max_tf"), F.col("idf")).alias("max_tfidf"),
            scoring.raw_bm25_bound(F.col("bm25_tf"), F.col("idf"), F.col("bm25_dl"), avgdl).alias("max_bm25"),
            (F.col("idf") * F.col("shape")).alias("ub_bm25_safe"),
        )
    )


def build(documents: DataFrame, stop_words: Sequence[str] | None = None, stem: bool = False) -> Index:
    """Index of documents(doc_id, doc_no, text). Texts are cleaned once: the analysed rows are kept in the shared folder, and
    statistics, lexicon and postings read what they need of them."""
    docs = cut(analysed(documents, stop_words, stem))
    doc_index = docs.select("doc_id", "doc_no", "doc_len")
    stats = collection_stats(doc_index)
    postings = postings_of(docs)
    return Index(doc_index, postings, lexicon_of(postings, stats), stats, docs)


def blocks_of(postings: DataFrame) -> DataFrame:
    """Posting blocks: term, block_no, nr_postings, min_doc_id, max_doc_id, doc_ids, tfs (arrays in doc_id order).

    Terms without one posting in 20,000 meet in one shuffle, which ranks and groups them. The heavier ones, which a
    sketch names, are ranked in chunks of doc_id. A block never exceeds max(511, sqrt(df) + 1) postings, so no task holds
    the list of a frequent term.
    """
    rows = postings.select("term", "doc_id", "tf")
    heavy, light = heavy_keys(rows, "term", RANK_CHUNK).split(rows, "term")
    by_term = Window.partitionBy("term")
    ranked = light.withColumn("rank", F.row_number().over(by_term.orderBy("doc_id")) - 1).withColumn("df", F.count(F.lit(1)).over(by_term))
    blocks = _blocks(ranked)
    if heavy is None:
        return blocks
    chunk = F.floor(F.col("doc_id") / F.lit(RANK_CHUNK))
    return blocks.unionByName(_blocks(chunked_row_number(heavy, "term", "doc_id", chunk, total="df")))


def _blocks(ranked: DataFrame) -> DataFrame:
    per_block = F.ceil(F.col("df") / block_count(F.col("df")))
    return (
        ranked.withColumn("block_no", F.floor(F.col("rank") / per_block).cast("int"))
        .groupBy("term", "block_no")
        .agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("p"))
        .select(
            "term", "block_no", F.size("p").alias("nr_postings"), F.element_at("p", 1)["doc_id"].alias("min_doc_id"),
            F.element_at("p", -1)["doc_id"].alias("max_doc_id"), F.col("p.doc_id").alias("doc_ids"), F.col("p.tf").alias("tfs"),
        )
    )


def lookup(lexicon: DataFrame, terms: DataFrame) -> DataFrame:
    """Lexicon rows of the wanted terms; unknown terms give no row. A literal list is better served by a filter."""
    return lexicon.join(terms.select("term").distinct(), "term", "left_semi")


def df_histogram(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("df").agg(F.count(F.lit(1)).alias("terms"))


def top_df_terms(lexicon: DataFrame, k: int) -> DataFrame:
    return lexicon.select("term", "df").orderBy(F.col("df").desc(), "term").limit(k)


def list_lengths(lexicon: DataFrame) -> DataFrame:
    """terms, postings, mean, weighted_mean, longest: one row. The weighted mean counts every list as often as it is long,
    so it is the length of the list a random posting belongs to. Null without terms."""
    df = F.col("df").cast("double")
    return lexicon.agg(
        F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"), F.avg(df).alias("mean"),
        (F.sum(df * df) / F.sum(df)).alias("weighted_mean"), F.max("df").alias("longest"),
    )


def merge_lexicons(partials: DataFrame) -> DataFrame:
    """One row a term of partial lexicons(spimi_block, term, df, max_tfidf, max_bm25): term, df, num_blocks, bounds.

    Terms lose trailing blanks; null terms are left aside; a (block, term, df) counts once, a null df as 0, null bounds not
    at all. df adds up over blocks, bounds take their maximum, the number of posting blocks follows from the merged df.
    """
    rows = partials.filter(F.col("term").isNotNull()).select("spimi_block", F.rtrim("term").alias("term"), "df", "max_tfidf", "max_bm25")
    once = rows.groupBy("spimi_block", "term", "df").agg(F.max("max_tfidf").alias("max_tfidf"), F.max("max_bm25").alias("max_bm25"))
    merged = once.groupBy("term").agg(
        F.sum(F.coalesce("df", F.lit(0))).cast("long").alias("df"), F.max("max_tfidf").alias("max_tfidf"), F.max("max_bm25").alias("max_bm25")
    )
    return merged.select("term", "df", block_count(F.col("df")).alias("num_blocks"), "max_tfidf", "max_bm25")


def with_lengths(postings: DataFrame, doc_index: DataFrame) -> DataFrame:
    """Postings(term, doc_id, tf) with ``doc_len`` of their documents: terms trimmed and non-null, repeated (term, doc_id)
    once with their largest tf (null counts as 0). Unknown documents and unknown lengths give a null length."""
    lengths = doc_index.groupBy("doc_id").agg(F.max("doc_len").alias("doc_len"))
    once = postings.filter(F.col("term").isNotNull()).groupBy(F.rtrim("term").alias("term"), "doc_id").agg(F.max(F.coalesce("tf", F.lit(0))).alias("tf"))
    return once.join(lengths, "doc_id", "left").select("term", "doc_id", "tf", "doc_len")
