"""Brand and category names: surface forms to canonical ones, and known names in queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import fixed, text
from lodestone.functions.joins import against_all

FORMS = {"brand": fixed.BRAND_FORMS, "category": fixed.CATEGORY_FORMS}


def known_brands() -> tuple[str, ...]:
    return tuple(fixed.BRAND_FORMS)


def normalize_query(query: Column) -> Column:
    return F.lower(text.one_space(query))


def normalize_entity(name: Column, kind: str) -> Column:
    """Canonical name: lower case, trimmed, and by the table of forms; unknown names as they are."""
    canon = {form: canon for canon, forms in FORMS[kind].items() for form in forms}
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return text.lookup(canon, low, low)


def forms_table(spark: SparkSession) -> DataFrame:
    """entity_synonyms(kind, canon, surface, ordinal); ordinal: the place of the canonical name."""
    rows = [(kind, canon, surface, k) for kind, entries in FORMS.items() for k, (canon, forms) in enumerate(entries.items()) for surface in forms]
    return spark.createDataFrame(rows, "kind string, canon string, surface string, ordinal int")


def first_brand(queries: DataFrame, brands: DataFrame, query: str = "query") -> DataFrame:
    """queries with query_brand: the first brand (name, ordinal) that the normalised query contains, else null.

    The brand table is a dimension of a few hundred names; it is counted before it is broadcast for the containment join.
    """
    hits = against_all(queries.select(query).distinct(), brands, "name").where(F.contains(normalize_query(F.col(query)), F.col("name")))
    best = hits.groupBy(query).agg(F.min_by("name", "ordinal").alias("query_brand"))
    return queries.join(best, query, "left")
