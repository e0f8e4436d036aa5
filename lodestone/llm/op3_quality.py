"""Quality rules: counts every document must pass, then a hashed n-gram log-likelihood ratio.

Word uni- and bigrams are hashed into 2**BITS buckets. Two multinomials over the buckets, trusted target
(documents labelled quality 1 and toxic 0) and raw corpus (all documents), give each bucket the log ratio
of its target count to the count expected of the target if it were like the corpus, both smoothed by
SMOOTH. A document's score is the mean over its n-grams, and it is kept at THRESHOLD or more: one fixed
number for every document and size.

The target is read from at most MAX_LABELS labelled documents (the first by a hash of the id), the raw
counts from all documents. What reaches the driver is two arrays of 2**BITS counts.

Defined results: a null text has no words and fails the base rules. Null ids are never in the target.
Repeated rows count each time. Empty tables give empty results; without labels every ratio is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import batch_of, documents, freed, mix, pack_bytes, prepare, unpack_bytes

BITS = 18
#: Bound of the labelled sample that the target is fitted on.
MAX_LABELS = 20_000
SMOOTH = 30.0
THRESHOLD = -0.09
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
CHUNK = 1 << 12
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
FIELDS = [(c.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[c.split()[1]]) for c in COLUMNS.split(", ")]


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    ids: dict[tuple, int] = {}
    number = np.fromiter((ids.setdefault(w, len(ids)) for w in windows), np.int64, len(windows))
    again = np.bincount(number)[number] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(windows)] |= again
    return int(hit.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int, bool]:
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = repeat_words(words)
    n = len(words)
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, n < MIN_WORDS or 100 * repeated > 50 * n


def buckets(text: str) -> np.ndarray:
    """Buckets of a text's word uni- and bigrams."""
    words = text.encode().split()
    one = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0x9E3779B1) + one[1:] + np.uint64(1)
    return (mix(np.concatenate([one, two])) >> np.uint64(64 - BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], trusted: frozenset[int]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            got = np.bincount(buckets(text or ""), minlength=1) if text else np.zeros(1, np.int64)
            raw[: len(got)] += got
            if doc_id in trusted:
                target[: len(got)] += got
    schema = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])
    n = (1 << BITS) // CHUNK
    both = [pack_bytes(raw[k * CHUNK : (k + 1) * CHUNK].tobytes() + target[k * CHUNK : (k + 1) * CHUNK].tobytes()) for k in range(n)]
    yield batch_of({"chunk": list(range(n)), "counts": both}, schema)


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(unpack_bytes(x.as_py()), np.int64) for x in table.column("counts"))
    schema = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])
    return pa.Table.from_batches([batch_of({"chunk": [table.column("chunk")[0].as_py()], "counts": [total.tobytes()]}, schema)])


def fit_ratio(docs: DataFrame, labels: DataFrame | None, max_labels: int = MAX_LABELS) -> np.ndarray:
    """Log ratio of target to corpus for each bucket (float32)."""
    trusted: frozenset[int] = frozenset()
    if labels is not None:
        good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        trusted = frozenset(r["doc_id"] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).collect())
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for row in rows.mapInArrow(lambda it: _count(it, trusted), "chunk int, counts binary").groupBy("chunk").applyInArrow(_add, "chunk int, counts binary").collect():
        both = np.frombuffer(row["counts"], np.int64)
        raw[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK], target[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = both[:CHUNK], both[CHUNK:]
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    return np.log((target + SMOOTH) / (expected + SMOOTH)).astype(np.float32)


def judge(docs: DataFrame, labels: DataFrame | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the counts, the score and the verdict `kept`; columns of docs that clash with these give way."""
    spark = docs.sparkSession
    prepare(spark)
    ratio = spark.sparkContext.broadcast(fit_ratio(docs, labels))  # 2**BITS floats
    taken = {name for name, _ in FIELDS} - {"doc_id", "text"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratio.value
        for batch in batches:
            rows = []
            for text in batch.column(names.index("text")).to_pylist():
                base = base_counts(text or "")
                at = buckets(text or "") if base[0] else np.zeros(0, np.int64)
                score = float(table[at].mean(dtype=np.float64)) if len(at) else 0.0
                rows.append((*base, score, not base[-1] and score >= threshold))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in FIELDS]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, (_, t) in zip(cols, FIELDS, strict=True))], names=[*names, *(n for n, _ in FIELDS)])
            freed()

    return docs.mapInArrow(run, f"{schema}, {COLUMNS}")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")
