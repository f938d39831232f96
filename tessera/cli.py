"""Command line: ``python -m tessera.cli index|query|evaluate``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from tessera.functions.stopwords import ENGLISH, read_stop_words
from tessera.operators import evaluate
from tessera.plans.engine import SearchEngine
from tessera.sources import collection


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("index", "query", "evaluate"):
        sub = commands.add_parser(name)
        sub.add_argument("--index", required=True)
        sub.add_argument("--stem", action="store_true")
        sub.add_argument("--remove-stop-words", action="store_true")
        sub.add_argument("--stop-words", help="file, one word a line")
        if name == "index":
            sub.add_argument("--collection", required=True)
            sub.add_argument("--partitions", type=int)
            sub.add_argument("--blocks", action="store_true")
            sub.add_argument("--strip-header", action="store_true", help="the collection is a compressed tar archive read as text")
        else:
            sub.add_argument("--scoring", choices=["tfidf", "bm25"], default="tfidf")
            sub.add_argument("--algorithm", choices=["daat", "maxscore"], default="daat")
            sub.add_argument("--conjunctive", action="store_true")
            sub.add_argument("--cache", action="store_true")
            sub.add_argument("-k", type=int, default=10)
            if name == "evaluate":
                sub.add_argument("--topics", required=True)
                sub.add_argument("--qrels", required=True)
                sub.add_argument("--latency", type=int, default=0, metavar="N", help="also time so many topics one by one")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    stops = read_stop_words(args.stop_words) if args.stop_words else sorted(ENGLISH) if args.remove_stop_words else None
    if args.command == "index":
        documents = collection.read_collection(spark, args.collection, args.partitions, args.strip_header, numbered=True)
        SearchEngine.build(documents, stops, args.stem, args.index, args.blocks)
        return
    how = {"scoring": args.scoring, "algorithm": args.algorithm, "k": args.k, "conjunctive": args.conjunctive}
    with SearchEngine.load(spark, args.index, stops, args.stem, args.cache) as engine:
        if args.command == "evaluate":
            qrels = collection.read_qrels(spark, args.qrels)
            topics = collection.read_topics(spark, args.topics).join(qrels.select("query_id").distinct(), "query_id", "left_semi")
            evaluate.summary(evaluate.metrics(engine.search_batch(topics, **how), qrels, args.k)).show(truncate=False)
            if args.latency:
                texts = [r["text"] for r in topics.orderBy("query_id").limit(args.latency).collect()]
                print("seconds a query: mean {:.3f}, deviation {:.3f}".format(*engine.latency(texts, **how)))
            return
        while query := input("query (empty ends): ").strip():
            began = time.perf_counter()
            engine.search(query, **how).orderBy("rank").show(args.k, truncate=False)
            print(f"{(time.perf_counter() - began) * 1000:.0f} ms")


if __name__ == "__main__":
    main()
