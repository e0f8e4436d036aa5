"""Training candidates of each query: labelled items, hard negatives, filler.

Labels are merged, never broadcast: they grow with the items, and Spark sizes them by the compressed file they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELLED, HARD, FILLER = 0, 1, 2


def above_quartile(retrieved: DataFrame, share: float = 0.25) -> DataFrame:
    """Rows (qid, pid, score) at or above the interpolated percentile of their query's scores."""
    floor = retrieved.groupBy("qid").agg(F.percentile("score", F.lit(share)).alias("floor"))
    return retrieved.join(floor, "qid").where("score >= floor").drop("floor")


def relative_score(retrieved: DataFrame) -> DataFrame:
    top = F.greatest(F.max("score").over(Window.partitionBy("qid")), F.lit(1e-6))
    return retrieved.withColumn("relative", F.col("score") / top)


def _tiered(kept: DataFrame, labels: DataFrame, hard: Column) -> DataFrame:
    labelled = labels.groupBy("qid", "pid").agg(F.max("relevance").alias("relevance"))
    new = kept.join(labelled.select("qid", "pid").hint("merge"), ["qid", "pid"], "left_anti").select("qid", "pid", F.when(hard, HARD).otherwise(FILLER).alias("tier"), "score")
    own = labelled.select("qid", "pid", F.lit(LABELLED).alias("tier"), F.col("relevance").cast("double").alias("score"))
    w = Window.partitionBy("qid", "tier").orderBy(F.desc("score"), "pid")
    return own.unionByName(new).select("qid", "pid", "tier", F.row_number().over(w).alias("tier_rank"))


def tiers(retrieved: DataFrame, labels: DataFrame, threshold: float = 0.7, share: float = 0.25) -> DataFrame:
    """(qid, pid, tier, tier_rank). retrieved: qid, pid, score, brand_match; labels: qid, pid, relevance."""
    kept = relative_score(above_quartile(retrieved, share))
    return _tiered(kept, labels, (F.col("relative") > threshold) & (F.col("brand_match") == 0))


def semantic_tiers(retrieved: DataFrame, labels: DataFrame, keep: float = 0.5, hard: float = 0.6) -> DataFrame:
    """tiers() of a retrieval by cosine alone (score): items over `keep` stay, those over `hard` of another brand are hard negatives.

    These are squared distances of unit vectors under 1.0 and under 0.8."""
    return _tiered(retrieved.where(F.col("score") > keep), labels, (F.col("score") > hard) & (F.col("brand_match") == 0))


def compose(tiered: DataFrame, k: int, max_hard: int = 10) -> DataFrame:
    """(qid, pid, tier, place): labelled, then at most max_hard hard negatives, then filler, cut at k."""
    w = Window.partitionBy("qid").orderBy("tier", "tier_rank")
    kept = tiered.where((F.col("tier") != HARD) | (F.col("tier_rank") <= max_hard))
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("qid", "pid", "tier", "place")


def with_labels(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """candidates with relevance, 0 where there is no label."""
    best = labels.groupBy("qid", "pid").agg(F.max("relevance").alias("relevance"))
    return candidates.join(best.hint("merge"), ["qid", "pid"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))


def useful_groups(candidates: DataFrame) -> DataFrame:
    """Groups of two candidates or more with a relevant one."""
    w = Window.partitionBy("qid")
    return candidates.withColumn("n", F.count("*").over(w)).withColumn("top", F.max("relevance").over(w)).where("n >= 2 and top > 0").drop("n", "top")
