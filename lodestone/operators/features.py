"""The 14-column feature vector of (query, item) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import entities, fixed
from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.sources.providers import Embeddings
from lodestone.sources.stores import written


def with_catalog_columns(catalog: DataFrame) -> DataFrame:
    """pid, title, brand, category and what every query needs of them, computed once an item."""
    title = F.lower(F.coalesce("title", F.lit("")))
    return catalog.select(
        "*",
        title.alias("title_low"),
        T.tokens(F.col("title")).alias("title_tokens"),
        entities.normalize_entity(F.col("brand"), "brand").alias("brand_norm"),
        entities.normalize_entity(F.col("category"), "category").alias("category_norm"),
    )


def match(entity: Column, query: Column) -> Column:
    return ((entity != "") & F.contains(query, entity)).cast("double")


def feature_columns(bm25_norm: float = 10.0) -> dict[str, Column]:
    """Expressions over pairs with query, bm25, title_low, title_tokens, brand_norm, category_norm, semantic, cross_lingual."""
    q = entities.normalize_query(F.col("query"))
    kind = T.intent(F.col("query"), entities.known_brands())
    words = T.tokens(F.col("query"))
    f: dict[str, Column] = {
        "semantic_sim": F.col("semantic"),
        "cross_lingual_sim": F.col("cross_lingual"),
        "bm25_score": F.col("bm25") / bm25_norm,
        "jaccard": T.jaccard(words, F.col("title_tokens")),
        "brand_match": match(F.col("brand_norm"), q),
        "category_match": match(F.col("category_norm"), q),
        "exact_title_match": F.contains(F.col("title_low"), q).cast("double"),
        "query_len": T.distinct_count(words).cast("double"),
        "intent_brand_weight": (kind == "BRAND").cast("double"),
        "intent_sku_weight": (kind == "SKU").cast("double"),
        "intent_generic_weight": (kind == "GENERIC").cast("double"),
    }
    f["semantic_channel"] = (f["semantic_sim"] + f["cross_lingual_sim"]) / 2
    f["lexical_channel"] = (f["bm25_score"] + f["jaccard"] + f["exact_title_match"]) / 3
    f["constraint_channel"] = (f["brand_match"] + f["category_match"] + f["intent_brand_weight"]) / 3
    return f


def feature_matrix(pairs: DataFrame, keep: list[str], bm25_norm: float = 10.0) -> DataFrame:
    """keep and the features, in their fixed order, as floats."""
    made = feature_columns(bm25_norm)
    return pairs.select(*keep, *[made[n].cast("float").alias(n) for n in fixed.FEATURES])


def hashed_similarities(pairs: DataFrame, dimension: int = 64) -> DataFrame:
    """semantic and cross_lingual from hashed vectors, for items and queries without given embeddings."""
    item = V.hashed_embedding(F.col("title_tokens"), dimension)
    plain = V.hashed_embedding(T.tokens(F.col("query")), dimension)
    translated = T.translate_words(F.col("query"))
    other = V.hashed_embedding(T.tokens(translated), dimension)
    out = pairs.withColumn("semantic", V.cosine(plain, item))
    return out.withColumn("cross_lingual", F.when(translated != T.one_space(F.col("query")), V.cosine(other, item)).otherwise(F.col("semantic")))


def similarities(pairs: DataFrame, embeddings: Embeddings) -> DataFrame:
    """semantic and cross_lingual of pairs (query, title, ...) by a provider's vectors of the distinct texts; 0 where one has none."""
    words = pairs.withColumn("_translated", T.translate_words(F.col("query")))
    texts = words.select(F.explode(F.array("query", "title", "_translated")).alias("text")).where("text is not null").distinct()
    known = written(embeddings.vectors(texts, "text", "text"), "vectors")

    def side(name: str) -> DataFrame:
        return known.select(F.col("key").alias(name), F.col("vector").alias(f"{name}_v"))

    rows = words.join(side("query"), "query", "left").join(side("title"), "title", "left").join(side("_translated"), "_translated", "left")
    sim = lambda c: F.coalesce(V.cosine(F.col(c), F.col("title_v")), F.lit(0.0))
    rows = rows.withColumn("semantic", sim("query_v"))
    other = F.when(F.col("_translated") != T.one_space(F.col("query")), sim("_translated_v")).otherwise(F.col("semantic"))
    return rows.withColumn("cross_lingual", other).drop("_translated", "query_v", "title_v", "_translated_v")


def feature_stats(matrix: DataFrame) -> DataFrame:
    """(feature, mean, std): population deviation."""
    pairs = F.stack(F.lit(len(fixed.FEATURES)), *[x for n in fixed.FEATURES for x in (F.lit(n), F.col(n).cast("double"))]).alias("feature", "value")
    return matrix.select(pairs).groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
