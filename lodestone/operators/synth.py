"""Synthetic products, queries and labels: deterministic by (seed, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import entities, fixed
from lodestone.functions import text as T


def draw(seed: int, *keys) -> Column:
    """A non-negative hash of seed and keys (columns, or text literals)."""
    return F.pmod(F.xxhash64(F.lit(seed), *[k if isinstance(k, Column) else F.lit(k) for k in keys]), F.lit(1 << 40))


def share(seed: int, *keys) -> Column:
    return draw(seed, *keys) / float(1 << 40)


def pick(options: list[str], seed: int, *keys) -> Column:
    return F.get(F.array(*[F.lit(x) for x in options]), (draw(seed, *keys) % len(options)).cast("int"))


def plain_queries(catalog: DataFrame, n: int = 5) -> DataFrame:
    """Interactions of each product (pid, title, brand, category) with its first n plain templates, graded by rule."""
    rows = F.array(*[F.struct(F.lit(lang).alias("lang"), F.lit(t).alias("template")) for lang, t in fixed.PLAIN_QUERIES[:n]])
    made = catalog.select("pid", "title", "brand", "category", F.posexplode(rows).alias("template_no", "t"))
    made = made.withColumn("query", T.fill(F.col("t.template"), {"brand": F.col("brand"), "category": F.col("category")}))
    return made.select(
        F.concat(F.lit("q"), F.col("pid").cast("string"), F.lit("_"), F.substring("query", 1, 20)).alias("qid"),
        "pid",
        "query",
        F.col("t.lang").alias("query_lang"),
        F.col("title").alias("product_title"),
        "brand",
        "category",
        rule_grade(F.col("query"), F.col("brand"), F.col("category")).alias("relevance"),
        "template_no",
    )


def rule_grade(query: Column, brand: Column, category: Column) -> Column:
    """3 for brand and category, 2 for one of them, 1 for a buying word, else 0; marked queries are 0."""
    q = entities.normalize_query(query)
    b = F.contains(q, entities.normalize_entity(brand, "brand"))
    c = F.contains(q, entities.normalize_entity(category, "category"))
    marked = T.contains_any(F.lower(query), ("irrelevant", "hard_negative"))
    return F.when(marked, 0).when(b & c, 3).when(b | c, 2).when(T.contains_any(q, fixed.BUYING_WORDS), 1).otherwise(0)


def synonym_grade(query: Column, brand: Column, category: Column, model: Column, activity: Column) -> Column:
    """As rule_grade, but over synonym sets: any form in the query brings in all forms of its name."""
    q = F.lower(query)
    words = T.tokens(query)
    for forms in [*fixed.BRAND_FORMS.values(), *fixed.CATEGORY_FORMS.values()]:
        words = F.array_union(words, F.when(T.contains_any(q, forms), F.array(*[F.lit(x) for x in forms])).otherwise(F.array().cast("array<string>")))

    def forms_of(name: Column, kind: str, table: dict[str, list[str]]) -> Column:
        canon = entities.normalize_entity(name, kind)
        return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))]), canon), F.array(canon))

    b = F.arrays_overlap(words, forms_of(brand, "brand", fixed.BRAND_FORMS))
    c = F.arrays_overlap(words, forms_of(category, "category", fixed.CATEGORY_FORMS))
    said = lambda x: (F.coalesce(x, F.lit("")) != "") & F.contains(q, F.lower(F.coalesce(x, F.lit(""))))
    m = said(model)
    marked = T.contains_any(q, ("irrelevant", "hard_negative"))
    return F.when(marked, 0).when((b & c) | (b & m) | (c & m), 3).when(b | c, 2).when(T.contains_any(q, fixed.BUYING_WORDS_WIDE), 1).when(said(activity), 1).otherwise(0)


def catalog(spark: SparkSession, n: int, categories: list[str], brands: list[str], seed: int = 42) -> DataFrame:
    """n products: product_id, title_en, title_local by language, brand, category and attributes."""
    df = spark.range(n).select(F.col("id").alias("product_id"), pick(brands, seed, "brand", F.col("id")).alias("brand"), pick(categories, seed, "category", F.col("id")).alias("category"))
    attributes = F.create_map(*[x for name, options in fixed.SLOTS.items() for x in (F.lit(name), pick(options, seed, name, F.col("product_id")))])
    df = df.withColumn("attributes", attributes)
    by_kind = None
    for kind, templates in fixed.PRODUCT_TEMPLATES.items():
        one = pick(templates, seed, "title", F.col("product_id"))
        by_kind = F.when(F.col("category") == kind, one) if by_kind is None else by_kind.when(F.col("category") == kind, one)
    other = pick(fixed.PRODUCT_TEMPLATES["Electronics"], seed, "title", F.col("product_id"))
    slots = {"brand": F.col("brand"), "category": F.col("category")} | {s: F.col("attributes")[s] for s in fixed.SLOTS}
    df = df.withColumn("title_en", T.fill(by_kind.otherwise(other), slots))
    local = F.create_map(*[x for lang in fixed.TITLE_WORDS for x in (F.lit(lang), T.local_title(F.col("title_en"), F.col("brand"), F.col("category"), lang))])
    return df.select("product_id", "title_en", local.alias("title_local"), "brand", "category", "attributes")


def _synonym(name: Column, kind: str, ratio: float, seed: int, *keys) -> Column:
    table = fixed.BRAND_FORMS if kind == "brand" else fixed.CATEGORY_FORMS
    canon = entities.normalize_entity(name, kind)
    other = name
    for k, forms in table.items():
        other = F.when(canon == k, pick(forms, seed, f"which-{kind}", *keys)).otherwise(other)
    return F.when(share(seed, f"syn-{kind}", *keys) <= ratio, other).otherwise(name)


def _noise(query: Column, brand: Column, category: Column, seed: int, *keys) -> Column:
    """A masked brand or category, or a brand with two letters exchanged."""
    kind = draw(seed, "noise", *keys) % 3
    at = (F.lit(1) + draw(seed, "at", *keys) % F.greatest(F.length(brand) - 2, F.lit(1))).cast("int")
    no_brand = T.replace_ignoring_case(query, brand, pick(["[BRAND]", "some brand", ""], seed, "mask", *keys))
    no_category = T.replace_ignoring_case(query, category, pick(["[CATEGORY]", "something", ""], seed, "mask", *keys))
    return F.when(kind == 0, no_brand).when(kind == 1, no_category).otherwise(F.replace(query, brand, T.swap_letters(brand, at)))


def augmented_queries(products: DataFrame, n: int = 5, synonym_ratio: float = 0.3, noise_ratio: float = 0.05, seed: int = 42) -> DataFrame:
    """n queries for each product from the templates of all intents: product_id, template_no, text, lang, intent, relevance."""
    templates = [(intent, t) for intent, ts in fixed.QUERY_TEMPLATES.items() for t in ts]
    rows = F.array(*[F.struct(F.lit(i).alias("intent"), F.lit(t).alias("template")) for i, t in templates])
    made = products.select("*", F.posexplode(rows).alias("template_no", "t"))
    keys = (F.col("product_id"), F.col("template_no"))
    order = Window.partitionBy("product_id").orderBy(draw(seed, "order", *keys), "template_no")
    made = made.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    slots = {s: F.col("attributes")[s] for s in fixed.SLOTS} | {
        "syn_brand": _synonym(F.col("brand"), "brand", synonym_ratio, seed, *keys),
        "syn_category": _synonym(F.col("category"), "category", synonym_ratio, seed, *keys),
        "year": pick(["2023", "2024", "2025"], seed, "year", F.col("product_id")),
        "price": F.concat(F.lit("$"), (F.lit(50) + draw(seed, "price", F.col("product_id")) % 451).cast("string")),
        "location": pick(fixed.LOCATIONS, seed, "location", F.col("product_id")),
    }
    made = made.withColumn("clean", T.fill(F.col("t.template"), slots))
    noisy = F.when(share(seed, "noisy", *keys) < noise_ratio, _noise(F.col("clean"), F.col("brand"), F.col("category"), seed, *keys)).otherwise(F.col("clean"))
    many = F.col("t.intent").startswith("multilingual_")
    made = made.withColumn("text", noisy)
    return made.select(
        "product_id",
        "template_no",
        "place",
        "text",
        F.when(many, F.substring_index("t.intent", "_", -1)).otherwise(T.script_language(F.col("text"))).alias("lang"),
        F.when(many, "multilingual").otherwise(F.col("t.intent")).alias("intent"),
        synonym_grade(F.col("text"), F.col("brand"), F.col("category"), F.col("attributes")["model"], F.col("attributes")["activity"]).alias("relevance"),
        "brand",
        "category",
        "attributes",
    )


def hard_negatives(queries: DataFrame, queries_per: int = 5, ratio: float = 0.1, first: float = 0.3, seed: int = 42) -> DataFrame:
    """Near misses, graded 0, for the first queries of each product: product_id, text, lang, intent, relevance."""
    n = max(1, int(queries_per * ratio))
    head = max(1, int(queries_per * first))
    rows = F.array(*[F.struct(F.lit(r).alias("reason"), F.lit(t).alias("template")) for r, t in fixed.HARD_NEGATIVES])
    made = queries.where(F.col("place") <= head).select("product_id", "place", "lang", "brand", "category", "attributes", F.posexplode(rows).alias("no", "t"))
    keys = (F.col("product_id"), F.col("place"), F.col("no"))
    order = Window.partitionBy("product_id", "place").orderBy(draw(seed, "hard", *keys), "no")
    made = made.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)

    def other(options: list[str], own: Column, name: str) -> Column:
        kept = F.filter(F.array(*[F.lit(x) for x in options]), lambda x: F.lower(x) != F.lower(own))
        return F.get(kept, (draw(seed, name, *keys) % F.size(kept)).cast("int"))

    slots = {s: F.col("attributes")[s] for s in fixed.SLOTS} | {
        "brand": F.col("brand"),
        "category": F.col("category"),
        "wrong_brand": T.title_case(other(list(fixed.BRAND_FORMS), F.col("brand"), "brand")),
        "wrong_model": other(fixed.SLOTS["model"], F.col("attributes")["model"], "model"),
        "wrong_color": pick(fixed.SLOTS["color"], seed, "color", *keys),
        "wrong_size": pick(fixed.SLOTS["size"], seed, "size", *keys),
        "prev_year": pick(["2021", "2022", "2023"], seed, "prev", *keys),
    }
    return made.select("product_id", "place", T.fill(F.col("t.template"), slots).alias("text"), "lang", F.concat(F.lit("hard_negative_"), F.col("t.reason")).alias("intent"), F.lit(0).alias("relevance"))


def distill(rows: DataFrame, prefix: str = "synth_", score: str = "teacher_score") -> DataFrame:
    """Grades of synthetic rows from a teacher's score in [0, 1]; other rows keep theirs."""
    graded = T.half_even_grade(F.col(score)).cast("int")
    return rows.withColumn("relevance", F.when(F.col("pid").startswith(prefix), graded).otherwise(F.col("relevance")))
