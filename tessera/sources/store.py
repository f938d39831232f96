"""The index as Parquet: postings and lexicon sorted by term, so that footers and bloom filters prune a term lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.index import Index, Stats, blocks_of

TABLES = ("doc_index", "postings", "lexicon", "stats")


def save(index: Index, path: str, blocks: bool = False, mode: str = "errorifexists") -> Index:
    """Write the index and return the stored one. ``blocks`` adds the posting-block table."""
    index.doc_index.write.mode(mode).parquet(f"{path}/doc_index")
    # a range of a term's postings, not the whole term, is the unit: a frequent term spreads over several files
    index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode(mode).option(
        "parquet.bloom.filter.enabled#term", "true"
    ).parquet(f"{path}/postings")
    index.lexicon.repartitionByRange("term").sortWithinPartitions("term").write.mode(mode).option(
        "parquet.bloom.filter.enabled#term", "true"
    ).parquet(f"{path}/lexicon")
    spark = index.postings.sparkSession
    terms = spark.read.parquet(f"{path}/lexicon").count()
    row = [(index.stats.num_docs, index.stats.sum_len, terms)]
    spark.createDataFrame(row, "num_docs long, sum_len long, num_terms long").coalesce(1).write.mode(mode).parquet(f"{path}/stats")
    stored = load(spark, path)
    if blocks:
        blocks_of(stored.postings).write.mode(mode).parquet(f"{path}/blocks")
    return stored


def exists(spark: SparkSession, path: str) -> bool:
    """Whether every table of an index is there and complete."""
    jvm = spark.sparkContext._jvm
    for table in TABLES:
        marker = jvm.org.apache.hadoop.fs.Path(f"{path}/{table}/_SUCCESS")
        if not marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
            return False
    return True


def load(spark: SparkSession, path: str) -> Index:
    if not exists(spark, path):
        raise FileNotFoundError(f"no complete index at {path}")
    read = {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}
    row = read["stats"].first()
    return Index(read["doc_index"], read["postings"], read["lexicon"], Stats(row["num_docs"], row["sum_len"], row["num_terms"]))


def load_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/blocks")


def render_postings(blocks: DataFrame) -> DataFrame:
    """Debug text: ``term d:f d:f ...``, one line a block."""
    pairs = F.zip_with("doc_ids", "tfs", lambda d, f: F.concat_ws(":", d.cast("string"), f.cast("string")))
    return blocks.select(F.concat_ws(" ", "term", F.array_join(pairs, " ")).alias("value"))


def render_lexicon(lexicon: DataFrame) -> DataFrame:
    """Debug text: tab-separated, figures with three decimals."""
    figures = [F.format_string("%.3f", c) for c in ("idf", "max_tfidf", "max_bm25")]
    return lexicon.select(F.concat_ws("\t", F.rpad("term", 30, " "), F.col("df").cast("string"), F.col("max_tf").cast("string"), *figures).alias("value"))


def render_doc_index(doc_index: DataFrame) -> DataFrame:
    return doc_index.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "doc_no", F.col("doc_len").cast("string")).alias("value"))


def render_stats(stats: Stats) -> str:
    return f"Documents: {stats.num_docs}\nTerms: {stats.num_terms}\nSum of lengths: {stats.sum_len}\nAverage length: {stats.avgdl:.3f}\n"
