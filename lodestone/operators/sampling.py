"""Splits and samples by hashes of keys: the same in every run and for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXTRA = "__upsampled__"


def order_of(seed: int, *keys: str) -> Column:
    """Eight hex digits of a keyed hash as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("long")


def group_split(rows: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with `split`: whole groups, a share of 1 - test_size to train by the order of their hash.

    The cut is the hash value of rank int(n * (1 - test_size)), found among distinct groups by range counts,
    so no task holds all groups.
    """
    groups = rows.select("qid").distinct().withColumn("h", order_of(seed, "qid"))
    n = groups.count()
    want = int(n * (1 - test_size))
    cut = _kth(groups, want)
    return rows.join(groups.select("qid", F.when(F.struct("h", "qid") <= cut, "train").otherwise("val").alias("split")), "qid") if cut is not None else rows.withColumn("split", F.lit("val"))


def _kth(groups: DataFrame, k: int) -> Column | None:
    """(h, qid) of the k-th group by that order: a histogram of the hash finds the narrow range that holds it."""
    if k <= 0:
        return None
    width = 1 << 20
    counts = groups.groupBy(F.expr(f"h div {width}").alias("b")).count().collect()  # at most 4096 ranges
    before = 0
    for row in sorted(counts, key=lambda r: r["b"]):
        if before + row["count"] >= k:
            got = groups.where(F.expr(f"h div {width}") == row["b"]).orderBy("h", "qid").limit(k - before).agg(F.max(F.struct("h", "qid")).alias("x")).first()["x"]
            return F.struct(F.lit(got["h"]).alias("h"), F.lit(got["qid"]).alias("qid"))
        before += row["count"]
    return None


def first_by_hash(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """The first n rows by the hash of (qid, pid): whole ranges of the hash, and of the last range what is wanting."""
    hashed = rows.withColumn("_h", order_of(seed, "qid", "pid"))
    width = 1 << 20
    before = 0
    for row in sorted(hashed.groupBy(F.expr(f"_h div {width}").alias("b")).count().collect(), key=lambda r: r["b"]):  # at most 4096 ranges
        if before + row["count"] >= n:
            last = hashed.where(F.expr(f"_h div {width}") == row["b"]).orderBy("_h", "qid", "pid").limit(n - before)
            return hashed.where(F.expr(f"_h div {width}") < row["b"]).unionByName(last).drop("_h")
        before += row["count"]
    return rows


def downsample_negatives(rows: DataFrame, ratio: float = 3.0, seed: int = 42) -> DataFrame:
    """All positives and max(P, int(P * ratio)) negatives of each group; groups without positives lose all rows."""
    group = Window.partitionBy("qid")
    marked = rows.withColumn("_p", F.count_if(F.col("relevance") > 0).over(group)).withColumn("_neg", F.col("relevance") <= 0)
    rank = F.row_number().over(Window.partitionBy("qid", "_neg").orderBy(order_of(seed, "qid", "pid"), "pid"))
    keep = F.greatest(F.col("_p"), F.floor(F.col("_p") * ratio))
    return marked.withColumn("_rank", rank).where(~F.col("_neg") | (F.col("_rank") <= keep)).drop("_p", "_neg", "_rank")


def upsample_rare(rows: DataFrame, label: int = 1, target: float = 0.15, seed: int = 42) -> DataFrame:
    """rows and copies of rare ones, in a group of their own, until the label is `target` of the positives.

    A rare row gets its even share of copies, and rows first by hash one more: drawn evenly with replacement
    would need a place for every draw; the count is the same.
    """
    positives, rare = rows.agg(F.count_if(F.col("relevance") > 0), F.count_if(F.col("relevance") == label)).first()
    need = int(positives * target) - rare
    if need <= 0 or rare == 0:
        return rows
    each, more = divmod(need, rare)
    own = rows.where(F.col("relevance") == label)
    copies = own.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(each)))).drop("_k") if each else own.limit(0)
    last = first_by_hash(own, more, seed)
    extra = copies.unionByName(last).withColumn("qid", F.lit(EXTRA).cast(rows.schema["qid"].dataType))
    return rows.unionByName(extra)
