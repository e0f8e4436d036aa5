"""Okapi BM25 over a corpus (doc_idx, text) for many queries (qid, query) at once.

The corpus is read and cut into words once: the words and the length of each document are written out, and postings, document
frequencies and statistics all come from them. Only terms of the queries leave that scan as postings; document
frequencies of the whole vocabulary, counted map-side first, are needed for the mean that floors negative weights. The one-row
statistics are joined as a broadcast row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.sources.stores import written

K1, B, EPSILON = 1.5, 0.75, 0.25


def doc_tokens(corpus: DataFrame, lowercase: bool = True) -> DataFrame:
    """doc_idx, words, dl; lowercase=False keeps the case of documents while queries are lower-cased."""
    words: Column = T.tokens(F.col("text")) if lowercase else T.split_words(F.col("text"))
    return corpus.select("doc_idx", words.alias("words")).withColumn("dl", F.size("words"))


def postings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_idx, term, tf, dl of the wanted terms."""
    rows = docs.select("doc_idx", "dl", F.explode("words").alias("term")).join(wanted, "term", "left_semi")
    return rows.groupBy("doc_idx", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def document_frequency(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl, n_terms and avg_idf over the vocabulary."""
    return _stats_of(document_frequency(docs), docs)


def _stats_of(frequency: DataFrame, docs: DataFrame) -> DataFrame:
    size = docs.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    raw = frequency.crossJoin(F.broadcast(size)).select("n_docs", "avgdl", raw_idf().alias("idf"))
    return raw.agg(F.max("n_docs").alias("n_docs"), F.max("avgdl").alias("avgdl"), F.count("*").alias("n_terms"), F.avg("idf").alias("avg_idf"))


def raw_idf() -> Column:
    return F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, term, qtf."""
    return queries.select("qid", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def scores(corpus: DataFrame, queries: DataFrame, lowercase: bool = True, candidates: DataFrame | None = None) -> DataFrame:
    """(qid, doc_idx, score) of every document that shares a term with the query.

    candidates: (qid, doc_idx) to score alone; the statistics stay those of the whole corpus.
    """
    docs = written(doc_tokens(corpus, lowercase), "words")
    terms = query_terms(queries)
    wanted = terms.select("term").distinct()
    hits = postings(docs, wanted)
    known = written(document_frequency(docs), "document-frequency")
    weight = known.join(wanted, "term", "left_semi").crossJoin(F.broadcast(_stats_of(known, docs)))
    idf = F.when(raw_idf() < 0, EPSILON * F.col("avg_idf")).otherwise(raw_idf())
    weight = weight.select("term", idf.alias("idf"), "avgdl")
    pairs = hits.join(weight, "term").join(terms, "term")
    if candidates is not None:
        # merged, never broadcast: candidates grow with the corpus, and Spark sizes them by the compressed file they come from
        pairs = pairs.join(candidates.select("qid", "doc_idx").distinct().hint("merge"), ["qid", "doc_idx"], "left_semi")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return pairs.groupBy("qid", "doc_idx").agg(F.sum(part).alias("score"))


def topk(corpus: DataFrame, queries: DataFrame, k: int, include_zero: bool = True, lowercase: bool = True, digits: int = 9) -> DataFrame:
    """(qid, doc_idx, score, rank): best scores first, ties by doc_idx.

    include_zero: queries with fewer than k matches are filled with documents that match nothing, by doc_idx.
    At most 2k documents can be such fillers, so only those are paired with queries.
    """
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_idx")
    found = scores(corpus, queries, lowercase).select("qid", "doc_idx", F.round("score", digits).alias("score"))
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if not include_zero:
        return best
    first = corpus.select("doc_idx").orderBy("doc_idx").limit(2 * k)
    short = queries.select("qid").join(best.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= k), "qid", "left_anti")
    fill = short.crossJoin(F.broadcast(first)).join(best, ["qid", "doc_idx"], "left_anti").select("qid", "doc_idx", F.lit(0.0).alias("score"))
    return best.drop("rank").unionByName(fill).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
