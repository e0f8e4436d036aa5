"""Statistical language identification: naive Bayes over character trigrams.

fit() counts the trigrams of labelled texts; classify() sums their log probabilities for each language. Both are
joins and sums, so corpora and query sets may be of any size; the model's rows are bounded by languages x trigrams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T


def grams(text: Column) -> Column:
    """Trigrams of each lower-cased word between two spaces, repeats included; a null text has none."""
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(3)))
    return F.flatten(F.transform(T.tokens(text), of_word))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, logp) with add-one smoothing over the grams of all languages; the row without a gram is for unseen ones."""
    counts = rows.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(grams(F.col(text))).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    whole = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    known = counts.select("gram").distinct().agg(F.count("*").alias("v"))
    base = whole.crossJoin(F.broadcast(known))  # a row for each language
    seen = counts.join(F.broadcast(base), "lang").select("lang", "gram", F.ln((F.col("n") + 1) / (F.col("total") + F.col("v") + 1)).alias("logp"))
    return seen.unionByName(base.select("lang", F.lit(None).cast("string").alias("gram"), F.ln(1 / (F.col("total") + F.col("v") + 1)).alias("logp")))


def classify(rows: DataFrame, model: DataFrame, key: str, text: str = "text", default: str = "en") -> DataFrame:
    """(key, lang): the likeliest language of each text, ties by name; texts without trigrams get the default.

    A text costs its grams once: those a language has not met cost the row without a gram, which the sum begins with."""
    asked = rows.select(F.col(key).alias("key"), F.explode(grams(F.col(text))).alias("gram")).groupBy("key", "gram").agg(F.count("*").alias("c"))
    unseen = model.where("gram is null").select("lang", F.col("logp").alias("none"))
    gain = model.where("gram is not null").join(F.broadcast(unseen), "lang").select("lang", "gram", (F.col("logp") - F.col("none")).alias("gain"))
    found = asked.join(gain, "gram").groupBy("key", "lang").agg(F.sum(F.col("c") * F.col("gain")).alias("gain"))
    size = asked.groupBy("key").agg(F.sum("c").alias("c"))
    every = size.crossJoin(F.broadcast(unseen)).join(found, ["key", "lang"], "left").select("key", "lang", F.round(F.col("c") * F.col("none") + F.coalesce("gain", F.lit(0.0)), 6).alias("score"))
    best = every.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "lang"))).where("n = 1").select("key", "lang")
    return rows.select(F.col(key).alias("key")).join(best, "key", "left").select("key", F.coalesce("lang", F.lit(default)).alias("lang"))
