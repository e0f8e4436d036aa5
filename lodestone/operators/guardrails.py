"""Deterministic corrections of model scores: brand, category, accessories, score gap.

Rows: qid, pid, query, score, brand_match, category. Each rule is one window stage, in the order of the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import entities, fixed
from lodestone.functions import text as T

def group():
    return Window.partitionBy("qid")


def _has_brand(query: Column) -> Column:
    translated = entities.normalize_query(T.translate_words(query))
    brands = entities.known_brands()
    return T.contains_any(entities.normalize_query(query), brands) | T.contains_any(translated, brands)


def _in(column: Column, values) -> Column:
    return column.isin(*values)


def demote_brand_training(rows: DataFrame, threshold: float = 0.9, factor: float = 0.1) -> DataFrame:
    named = T.contains_any(entities.normalize_query(F.col("query")), entities.known_brands())
    hit = named & (F.col("brand_match") == 0) & (F.col("score") < threshold)
    return rows.withColumn("score", F.when(hit, F.col("score") * factor).otherwise(F.col("score")))


def cap_accessories_training(rows: DataFrame, gap: float = 0.1, top: int = 10) -> DataFrame:
    """Accessories of the top rows fall below their weakest primary, where the query names a primary category."""
    aimed = T.contains_any(entities.normalize_query(F.col("query")), fixed.PRIMARY_TRAINING)
    kind = entities.normalize_entity(F.col("category"), "category")
    return _cap(rows, aimed, _in(kind, fixed.PRIMARY_TRAINING), _in(kind, fixed.ACCESSORIES), F.lit(gap), top)


def _cap(rows: DataFrame, aimed: Column, primary: Column, accessory: Column, gap: Column, top: int) -> DataFrame:
    rank = F.row_number().over(group().orderBy(F.desc("score"), "pid"))
    marked = rows.withColumn("_gap", gap).withColumn("_top", (rank <= top) & aimed)
    weakest = F.min(F.when(F.col("_top") & primary, F.col("score"))).over(group())
    marked = marked.withColumn("_floor", weakest)
    capped = F.when(F.col("_top") & accessory & F.col("_floor").isNotNull(), F.least("score", F.col("_floor") - F.col("_gap"))).otherwise(F.col("score"))
    return marked.withColumn("score", capped).drop("_gap", "_top", "_floor")


def _median(rows: DataFrame, name: str) -> DataFrame:
    return rows.join(rows.groupBy("qid").agg(F.median("score").alias(name)), "qid")


def demote_brand_serving(rows: DataFrame, factor: float = 0.1) -> DataFrame:
    hit = _has_brand(F.col("query")) & (F.col("brand_match") == 0) & (F.col("score") < F.col("_median"))
    return _median(rows, "_median").withColumn("score", F.when(hit, F.col("score") * factor).otherwise(F.col("score"))).drop("_median")


def query_category(query: Column) -> Column:
    """The first primary category that the query or its translation contains, by its alias; else null."""
    plain, other = entities.normalize_query(query), entities.normalize_query(T.translate_words(query))
    found = F.coalesce(*[F.when(F.contains(plain, F.lit(c)) | F.contains(other, F.lit(c)), F.lit(fixed.CATEGORY_ALIASES.get(c, c))) for c in fixed.PRIMARY_SERVING])
    return found


def item_category(category: Column) -> Column:
    canon = entities.normalize_entity(category, "category")
    return T.lookup(fixed.CATEGORY_ALIASES, canon, canon)


def steer_category(rows: DataFrame, demote: float = 0.05, boost: float = 0.5) -> DataFrame:
    """Known other categories below the median fall, the asked category rises by half the median's size."""
    rows = _median(rows, "_median").withColumn("_target", query_category(F.col("query"))).withColumn("_kind", item_category(F.col("category")))
    off = F.col("_target").isNotNull() & (F.col("_kind") != F.col("_target")) & ~_in(F.col("_kind"), fixed.UNKNOWN_CATEGORIES) & (F.col("score") < F.col("_median"))
    on = F.col("_target").isNotNull() & (F.col("_kind") == F.col("_target"))
    score = F.when(off, F.col("score") * demote).when(on, F.col("score") + F.abs("_median") * boost).otherwise(F.col("score"))
    return rows.withColumn("score", score).drop("_median", "_target", "_kind")


def cap_accessories_serving(rows: DataFrame, top: int = 10) -> DataFrame:
    spread = (F.max("score").over(group()) - F.min("score").over(group())) * 0.01
    target, kind = query_category(F.col("query")), item_category(F.col("category"))
    return _cap(rows, target.isNotNull(), F.coalesce(kind == target, F.lit(False)), _in(kind, fixed.ACCESSORIES), F.when(spread == 0, 0.01).otherwise(spread), top)


def training_guardrails(rows: DataFrame, threshold: float = 0.9, factor: float = 0.1) -> DataFrame:
    return cap_accessories_training(demote_brand_training(rows, threshold, factor), factor)


def serving_guardrails(rows: DataFrame) -> DataFrame:
    return cap_accessories_serving(steer_category(demote_brand_serving(rows)))


def score_gap_cut(rows: DataFrame, k: int, least: float = 3.0, share: float = 0.4) -> DataFrame:
    """Rows over the top score less max(least, share of the range), then the first k, with their rank."""
    top, low = F.max("score").over(group()), F.min("score").over(group())
    kept = rows.withColumn("_cut", top - F.greatest(F.lit(least), (top - low) * share)).where("score > _cut").drop("_cut")
    return kept.withColumn("rank", F.row_number().over(group().orderBy(F.desc("score"), "pid"))).where(F.col("rank") <= k)
