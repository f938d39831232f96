"""Collections, topics and judgments from files, and the matching writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.heavy import estimated_bytes
from tessera.operators.ranking import dense_ids, ids_by_file


def read_collection(spark: SparkSession, path: str, partitions: int | None = None, strip_header: bool = False, numbered: bool = False) -> DataFrame:
    """doc_no, text of tab-separated lines; gzip is read as such. ``numbered`` puts a dense doc_id before them, from 0 in the
    order of the lines (files by name), which is what judgments that name documents by number mean.

    A gzip file is one task, so the lines are spread over all cores before any work on them, or over ``partitions``. A line
    without a tab is a document number with a null text; lines without a document number are left out. ``strip_header``
    drops the archive header that precedes the first document's ``0`` and tab when a tar archive was compressed as it is;
    only lines with NUL bytes, which the header always has, are touched.
    """
    value = F.col("value")
    if strip_header:
        headed = value.contains("\x00") | value.rlike(r"^[^\t]*[^\t\d][^\t]*0\t")
        value = F.when(headed, F.regexp_replace(value, r"(?s)^.*?0\t", "0\t")).otherwise(value)
    parts = F.split(value, "\t", 2)
    lines = spark.read.text(path)
    if numbered:
        kept = lines.filter(F.coalesce(parts[0], F.lit("")) != "")
        lines = ids_by_file(kept, "doc_id")
    rows = lines.select(*(["doc_id"] if numbered else []), parts[0].alias("doc_no"), F.get(parts, F.lit(1)).alias("text")).filter(F.col("doc_no") != "")
    return rows.repartition(partitions) if partitions else spread(rows)


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a file scan over all cores where its files give it fewer parts than these: a small or unsplittable file would
    keep one task busy with all text work. Larger scans, which have parts enough, stay as they are, without a shuffle."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = rows.inputFiles()
    if files and all(f.endswith((".gz", ".bz2")) for f in files):
        parts = len(files)
    else:
        parts = estimated_bytes(rows) // int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return rows.repartition(cores) if parts < cores else rows


def from_rows(spark: SparkSession, rows: list[tuple[str, str | None]]) -> DataFrame:
    return spark.createDataFrame(rows, "doc_no string, text string")


def with_ids(collection: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Dense doc_id from 0 in the order of the rows, or along ``order``. For files see ``read_collection(numbered=True)``."""
    return dense_ids(collection.select("doc_no", "text"), order).select("doc_id", "doc_no", "text")


def write_collection(collection: DataFrame, path: str) -> None:
    line = F.concat_ws("\t", F.coalesce("doc_no", F.lit("")), F.coalesce("text", F.lit("")))
    collection.select(line.alias("value")).write.option("compression", "gzip").text(path)


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text of tab-separated lines without header or quoting."""
    return spark.read.csv(path, sep="\t", quote="", schema="query_id int, text string")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, relevance of space-separated lines; of repeated pairs the last line wins (its place in the file)."""
    rows = spark.read.csv(path, sep=" ", schema="query_id int, unused string, doc_id long, relevance int")
    placed = rows.withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    return placed.groupBy("query_id", "doc_id").agg(F.max_by("relevance", "_at").alias("relevance"))
