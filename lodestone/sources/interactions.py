"""Labelled query-item interactions: external scan, union of sources, validation, catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions import text as T

SCHEMA = "qid string, pid string, query string, query_lang string, product_title string, product_title_local string, brand string, category string, relevance int, intent string"
REQUIRED = ("qid", "pid", "query", "product_title", "brand", "category", "relevance")
TEXTS = ("qid", "pid", "query", "product_title", "brand", "category")
EXTERNAL = "query_id string, product_id string, query string, product_locale string, product_title string, product_brand string, esci_label string"


def grade_of_label(label: Column) -> Column:
    return T.lookup(fixed.LABEL_GRADES, label, F.lit(0))


def from_external(rows: DataFrame, max_rows: int | None = None, order: str = "query_id", category: Column | None = None) -> DataFrame:
    """External rows in the interaction schema; nulls get '' or 'en', and the locale also serves as category unless one is given."""
    if max_rows is not None:
        rows = rows.orderBy(order, "product_id").limit(max_rows)
    text = lambda c, default="": F.coalesce(F.col(c), F.lit(default))
    locale = text("product_locale", "en")
    return rows.select(
        text("query_id").alias("qid"),
        text("product_id").alias("pid"),
        text("query").alias("query"),
        locale.alias("query_lang"),
        text("product_title").alias("product_title"),
        text("product_brand").alias("brand"),
        (locale if category is None else category).alias("category"),
        grade_of_label(F.col("esci_label")).alias("relevance"),
    )


def read_external(spark: SparkSession, path: str, fmt: str = "parquet", max_rows: int | None = None) -> DataFrame:
    return from_external(spark.read.schema(EXTERNAL).format(fmt).load(path), max_rows)


def union_sources(*sources: DataFrame | None) -> DataFrame:
    """Sources one after another, absent columns null; a source that is None (unavailable) is left out."""
    here = [s for s in sources if s is not None]
    if not here:
        raise ValueError("no source is available")
    out = here[0]
    for s in here[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def validate(rows: DataFrame, limit: int = 512) -> DataFrame:
    """rows with texts as strings of at most `limit` characters (nulls empty), or ValueError: a missing column, no row, a grade beyond 0..3."""
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    n, low, high = rows.agg(F.count("*"), F.min("relevance"), F.max("relevance")).first()
    if n == 0:
        raise ValueError("no interactions")
    if low is None or low < 0 or high > 3:
        raise ValueError(f"grades from {low} to {high} are not all within 0..3")
    return rows.withColumns({c: T.truncate(F.coalesce(F.col(c).cast("string"), F.lit("")), limit) for c in TEXTS})


def first_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by `order`."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def catalog(rows: DataFrame, order: list[str]) -> DataFrame:
    """pid, title, brand, category: the first row of each item."""
    return first_of(rows.select("pid", F.col("product_title").alias("title"), "brand", "category", *[c for c in order if c not in ("pid", "brand", "category")]), "pid", order).select("pid", "title", "brand", "category")
