"""Ranking metrics over (qid, relevance, score) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 9


def ndcg(rows: DataFrame, k: int = 10, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """keys and ndcg: linear gain, ties share the mean of their discounts; groups without a relevant row are left out."""
    discount = F.when(F.col("rn") <= k, 1 / F.log2(F.col("rn") + 1)).otherwise(0.0)
    base = rows.select(*keys, F.col("relevance").cast("double").alias("gain"), F.round("score", DIGITS).alias("score"))
    ranked = base.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score")))).withColumn("d", discount)
    dcg = ranked.groupBy(*keys, "score").agg((F.avg("gain") * F.sum("d")).alias("part")).groupBy(*keys).agg(F.sum("part").alias("dcg"))
    ideal = base.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("gain")))).withColumn("d", discount)
    idcg = ideal.groupBy(*keys).agg(F.sum(F.col("gain") * F.col("d")).alias("idcg"))
    return dcg.join(idcg.where("idcg > 0"), list(keys)).select(*keys, (F.col("dcg") / F.col("idcg")).alias("ndcg"))


def mrr(rows: DataFrame, keys: tuple[str, ...] = ("qid",), tie: str = "pid") -> DataFrame:
    """keys and rr: one over the rank of the first relevant row, 0 where there is none; ties by `tie`."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", DIGITS)), tie)
    ranked = rows.withColumn("rn", F.row_number().over(w))
    return ranked.groupBy(*keys).agg(F.coalesce(1 / F.min(F.when(F.col("relevance") > 0, F.col("rn"))), F.lit(0.0)).alias("rr"))


def mean_metrics(rows: DataFrame, k: int = 10, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """ndcg and mrr over groups that have a relevant row, by the keys besides qid; no such group, no row."""
    both = ndcg(rows, k, keys).join(mrr(rows, keys), list(keys))
    by = [c for c in keys if c != "qid"]
    out = both.groupBy(*by).agg(F.count("*").alias("n"), F.avg("ndcg").alias("ndcg"), F.avg("rr").alias("mrr"))
    return out.where("n > 0").drop("n")


def ablation(rows: DataFrame, methods: dict[str, str], k: int = 10) -> DataFrame:
    """(method, ndcg, mrr) of several score columns of the same rows (methods: name -> column)."""
    pairs = F.stack(F.lit(len(methods)), *[x for name, c in methods.items() for x in (F.lit(name), F.col(c).cast("double"))]).alias("method", "score")
    return mean_metrics(rows.select("qid", "pid", "relevance", pairs), k, ("method", "qid"))
