"""Serving: a batch of queries through retrieval, features, model, guardrails and the score gap, as one plan.

Joins with items are merged, never broadcast: items grow with the catalog, and Spark sizes them by the compressed file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import EngineConfig
from lodestone.functions import text as T
from lodestone.operators import bm25, candidates, evaluate, features, guardrails, model, retrieval, sampling, synth
from lodestone.sources import providers, stores


def retrieve(queries: DataFrame, items: DataFrame, config: EngineConfig, hybrid: bool = True, embeddings: providers.Embeddings | None = None) -> DataFrame:
    """(qid, pid, score, rank) of queries (qid, query) over items with catalog columns; embeddings: where vectors come from."""
    k = config.data.retrieval_k
    embeddings = embeddings or providers.HashedWords()
    asked = stores.written(embeddings.vectors(queries, "qid", "query").select(F.col("key").alias("qid"), F.col("vector").alias("q")), "query-vectors")
    given = stores.written(embeddings.vectors(items, "pid", "title").select(F.col("key").alias("doc_idx"), F.col("vector").alias("v")), "item-vectors")
    meaning = retrieval.search(asked, given, 2 * k if hybrid else k, embeddings.dimension, config.vectors)
    if hybrid:
        lexical = bm25.topk(items.select(F.col("pid").alias("doc_idx"), F.col("title").alias("text")), queries, 2 * k)
        found = retrieval.rrf([(meaning, config.data.semantic_weight), (lexical, config.data.bm25_weight)], k, config.data.rrf_k)
    else:
        found = meaning.withColumnRenamed("sim", "score")
    return found.select("qid", F.col("doc_idx").alias("pid"), "score", "rank")


def featurize(pairs: DataFrame, queries: DataFrame, items: DataFrame, config: EngineConfig, keep: list[str], embeddings: providers.Embeddings | None = None) -> DataFrame:
    """The features of pairs (qid, pid, ...), by BM25 over all items."""
    corpus = items.select(F.col("pid").alias("doc_idx"), F.col("title").alias("text"))
    lexical = bm25.scores(corpus, queries, candidates=pairs.select("qid", F.col("pid").alias("doc_idx"))).select("qid", F.col("doc_idx").alias("pid"), F.col("score").alias("bm25"))
    rows = pairs.join(queries, "qid").join(items.hint("merge"), "pid").join(lexical.hint("merge"), ["qid", "pid"], "left").fillna(0.0, ["bm25"])
    similar = features.similarities(rows, embeddings) if embeddings else features.hashed_similarities(rows)
    return features.feature_matrix(similar, keep, config.ranker.bm25_norm_factor)


def rank(queries: DataFrame, catalog: DataFrame, ranker: model.LambdaRanker, config: EngineConfig, k: int = 10, hybrid: bool = False, embeddings: providers.Embeddings | None = None) -> DataFrame:
    """(qid, pid, title, brand, category, score, rank) for every query; a query that finds nothing has no row. Scores are written before the guardrails, whose medians read them again."""
    items = features.with_catalog_columns(catalog)
    found = stores.written(retrieve(queries, items, config, hybrid, embeddings).select("qid", "pid"), "found")
    matrix = featurize(found, queries, items, config, ["qid", "pid", "query", "category"], embeddings)
    scores = stores.written(ranker.predict(matrix).select("qid", "pid", "query", "category", "score", "brand_match"), "scores")
    scored = guardrails.serving_guardrails(scores)
    cut = guardrails.score_gap_cut(scored, k)
    return cut.join(catalog.select("pid", "title", "brand").hint("merge"), "pid").select("qid", "pid", "title", "brand", "category", "score", "rank")


def training_rows(interactions: DataFrame, catalog: DataFrame, config: EngineConfig, hybrid: bool = True, embeddings: providers.Embeddings | None = None) -> DataFrame:
    """Features and relevance of the composed candidates of every query of interactions (qid, pid, query, relevance)."""
    items = features.with_catalog_columns(catalog)
    queries = stores.written(interactions.groupBy("qid").agg(F.min("query").alias("query")), "queries")
    brand = features.match(F.col("brand_norm"), F.lower(T.one_space(F.col("query"))))
    found = retrieve(queries, items, config, hybrid, embeddings).join(queries, "qid").join(items.select("pid", "brand_norm").hint("merge"), "pid").select("qid", "pid", "score", brand.alias("brand_match"))
    tiered = candidates.tiers(found, interactions, config.data.hard_negative_score) if hybrid else candidates.semantic_tiers(found, interactions)
    chosen = candidates.useful_groups(candidates.with_labels(candidates.compose(tiered, config.data.retrieval_k, config.data.max_hard_negatives), interactions))
    chosen = stores.written(chosen.select("qid", "pid", "relevance"), "training-candidates")
    return featurize(chosen, queries, items, config, ["qid", "pid", "query", "category", "relevance"], embeddings)


def train(interactions: DataFrame, catalog: DataFrame, config: EngineConfig, hybrid: bool = True, embeddings: providers.Embeddings | None = None) -> model.LambdaRanker:
    """Split by group, sample, and fit. The rows are written before the split, which reads them several times."""
    made = stores.written(training_rows(interactions, catalog, config, hybrid, embeddings), "features")
    rows = stores.written(sampling.group_split(made, config.ranker.test_size, config.data.seed), "training-rows")
    sampled = sampling.upsample_rare(sampling.downsample_negatives(rows.where("split = 'train'"), config.ranker.neg_downsample_ratio, config.data.seed), seed=config.data.seed)
    return model.LambdaRanker(config.ranker).fit(sampled, rows.where("split = 'val'"), config.data.seed)


def ablation(rows: DataFrame, ranker: model.LambdaRanker) -> DataFrame:
    """NDCG and MRR of lexical score, semantic score and the model over rows with features and relevance."""
    return evaluate.ablation(ranker.predict(rows, "full"), {"BM25": "bm25_score", "Semantic": "semantic_sim", "Full": "full"})


def demo_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Plain interactions (qid, pid, query, relevance) of the parts, and the parts as a catalog."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    items = part.select(F.col("p_partkey").alias("pid"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"))
    plain = synth.plain_queries(items).where("template_no <> 2").withColumn("qid", F.md5("query"))
    return plain.select("qid", "pid", "query", "relevance"), items


def demo(spark: SparkSession, sf: str) -> DataFrame:
    """Train on plain interactions of the parts, then rank the distinct brand-and-type queries."""
    config = EngineConfig()
    interactions, items = demo_tables(spark, sf)
    ranker = train(interactions, items, config)
    part = spark.read.parquet(f"{sf}/part.parquet")
    asked = part.select(F.concat_ws(" ", "p_brand", "p_type").alias("query")).distinct().withColumn("qid", F.md5("query"))
    return rank(asked, items, ranker, config)
