"""Command line: train a ranker, or rank queries with one.

    python -m lodestone train --interactions PATH --catalog PATH --models DIR [section.name=value ...]
    python -m lodestone rank --queries PATH --catalog PATH --models DIR --out PATH [-k N] [section.name=value ...]

Tables are Parquet: interactions (qid, pid, query, relevance, ...), catalog (pid, title, brand, category), queries (qid, query).
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lodestone.config import EngineConfig, with_overrides
from lodestone.operators.model import LambdaRanker
from lodestone.plans import serving
from lodestone.sources import stores


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lodestone", description="Train a ranker, or rank queries with one.")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("train", "rank"):
        own = commands.add_parser(name)
        own.add_argument("--catalog", required=True)
        own.add_argument("--models", required=True)
        own.add_argument("--name", default="ranker")
        own.add_argument("--semantic", action="store_true", help="retrieve by vectors alone")
        own.add_argument("overrides", nargs="*", metavar="section.name=value")
    commands.choices["train"].add_argument("--interactions", required=True)
    commands.choices["rank"].add_argument("--queries", required=True)
    commands.choices["rank"].add_argument("--out", required=True)
    commands.choices["rank"].add_argument("-k", type=int, default=10)
    args = parser.parse_args(argv)
    config = with_overrides(EngineConfig(), args.overrides)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    catalog = spark.read.parquet(args.catalog)
    if args.command == "train":
        ranker = serving.train(spark.read.parquet(args.interactions), catalog, config, hybrid=not args.semantic)
        ranker.save(args.models, args.name)
        last = ranker.history[-1] if ranker.history else {}
        stores.log_metrics(spark, args.models, args.name, {k: float(v) for k, v in last.items()}, {"overrides": " ".join(args.overrides)})
    else:
        ranker = LambdaRanker.load(args.models, args.name, config.ranker)
        serving.rank(spark.read.parquet(args.queries), catalog, ranker, config, args.k, hybrid=not args.semantic).write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
