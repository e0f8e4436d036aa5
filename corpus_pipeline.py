"""The training-data pipeline: quality rules, near-duplicate removal, substring removal, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written as Parquet and
read again before the next. All but the last return the columns of documents as they came.

Defined results, in every stage: nulls in any column stay as they are, a null text counts as an empty one, repeated
rows are rows of their own, an empty table gives an empty result, columns may have any names beside doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import op3_quality, op5_neardup, op8_substring, op9_packing
from lodestone.llm.common import materialize, prepare

Renamed = tuple[DataFrame, list[str]]


def _renamed(docs: DataFrame) -> Renamed:
    """docs with names that clash with nothing, doc_id and text as they are."""
    names = docs.columns
    return docs.toDF(*[n if n in ("doc_id", "text") else f"extra_{k}" for k, n in enumerate(names)]), names


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and short texts (under 50 words) go; equal texts fare alike, and the threshold is inclusive."""
    rows, names = _renamed(docs)
    judged = op3_quality.judge(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("kept").select(*rows.columns).toDF(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group of near duplicates (five-word similarity of 0.8 or more; see op5_neardup.keep_one).

    Of rows with one id the one whose text has the least hash stays; null ids stay only in groups without another. Texts without words are one group."""
    rows, names = _renamed(docs)
    return op5_neardup.keep_one(rows).toDF(*names)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words that lie in a passage found earlier and the white space after each; n_chars follows a text that changed.

    Earlier: by doc_id (null ids first, rows of one id by their text), then by place. A null text stays null."""
    rows, names = _renamed(docs)
    carry = tuple(c for c in rows.columns if c not in ("doc_id", "text"))
    found = op8_substring.remove_repeats(rows, carry=carry, layout=True)
    out = []
    for c, n in zip(rows.columns, names, strict=True):
        column = F.col("kept") if c == "text" else F.col(c)
        if n == "n_chars":
            column = F.when(F.col("n_removed") > 0, F.char_length("kept").cast(rows.schema[c].dataType)).otherwise(F.col(c))
        out.append(column.alias(n))
    return found.select(*out)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens. A null or empty text is its end token; null ids stay null."""
    return op9_packing.pack(docs)


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: The stages hash, link and factor texts and tokenize them with a library: no SQL for their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of sf_dir."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
