"""Document fingerprints: SimHash with length-weighted term hashes, and permuted block tables.

Terms are three-word shingles (A-Z lower-cased; a shorter text is one term), each voting on 64 signed
bits with the number of its bytes as weight, so longer and thus rarer terms count more.
``near_fingerprints`` finds every pair within a Hamming radius through permuted block tables: the bits
are cut into blocks, each table keys on all but ``radius`` of them, and a pair within the radius agrees
on the key of at least one table.

Defined results: a null text is empty; a text without words has the fingerprint of zeros. Null ids come
last in descending order, rows of one id follow each other by text. The only document of a table is its
own next. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import HashMemo, batch_of, doc_columns, documents, materialize, mix, prepare, range_edges

NO_ID = np.iinfo(np.int64).min
SEED = 7
_MEMO = HashMemo(SEED)
_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
FIELDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def terms(text: str, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of a text's shingles, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    hashes = _MEMO.hashes(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = max(1, len(words) - width + 1)
    total, weight = hashes[:n].copy(), sizes[:n].copy()
    for k in range(1, min(width, len(words))):
        total = mix(total * _MUL[0] + hashes[k : k + n] * _MUL[1])
        weight += sizes[k : k + n]
    return total, weight.astype(np.float32)


def simhash(hashes: np.ndarray, weights: np.ndarray, step: int = 1 << 15) -> int:
    """64 bits, each 1 where the weighted votes are positive."""
    votes = np.zeros(64, np.float64)
    for at in range(0, len(hashes), step):
        bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + step]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        w = weights[at : at + step]
        votes += 2.0 * (w @ bits.astype(np.float32)) - float(w.sum(dtype=np.float64))
    return int(np.packbits(votes > 0, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str) -> int:
    return simhash(*terms(text))


def likeness(a: int, b: int) -> float:
    return 1.0 - (a ^ b).bit_count() / 64


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the next document."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprint_edits(docs: DataFrame, part_bytes: int = 8 << 20) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how near they and the next document are.

    The documents are dealt once, by ranges of doc_id; the highest documents of each range are dealt
    to the range above as well (the highest of all to the lowest), so each task has every successor it needs.
    """
    prepare(docs.sparkSession)
    docs = doc_columns(docs)
    edges = np.array(range_edges(docs, part_bytes), np.int64)
    whole = F.coalesce("doc_id", F.lit(NO_ID))
    tops = docs.select(whole.alias("doc_id")).mapInArrow(lambda it: _tops(it, edges), "part long, top long").groupBy("part").agg(F.max("top").alias("top")).collect()
    tops = sorted((r["part"], r["top"]) for r in tops)  # one pair for each range: bounded by their number
    guest_at = {top: tops[(k + 1) % len(tops)][0] for k, (_, top) in enumerate(tops)}

    dealt = docs.mapInArrow(lambda it: _deal(it, edges, guest_at), "part long, guest boolean, doc_id long, text string")
    return dealt.groupBy("part").applyInArrow(_edit_part, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _tops(batches: Iterator[pa.RecordBatch], edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        if len(ids):
            part = np.searchsorted(edges, ids, side="right")
            parts = np.unique(part)
            yield pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int64()), "top": pa.array([ids[part == p].max() for p in parts], pa.int64())})


def _deal(batches: Iterator[pa.RecordBatch], edges: np.ndarray, guest_at: dict[int, int]) -> Iterator[pa.RecordBatch]:
    tops = np.array(sorted(guest_at), np.int64)
    for batch in batches:
        ids = batch.column("doc_id").fill_null(NO_ID)
        values = ids.to_numpy()
        part = np.searchsorted(edges, values, side="right")
        own = pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.zeros(len(part), bool)), batch.column("doc_id"), batch.column("text")], names=["part", "guest", "doc_id", "text"])
        yield own
        also = np.flatnonzero(np.isin(values, tops))
        if len(also):
            rows = pa.array(also)
            yield pa.RecordBatch.from_arrays([pa.array([guest_at[int(v)] for v in values[also]], pa.int64()), pa.array(np.ones(len(also), bool)), batch.column("doc_id").take(rows), batch.column("text").take(rows)], names=["part", "guest", "doc_id", "text"])


def _edit_part(table: pa.Table) -> pa.Table:
    rows = list(zip(table.column("guest").to_pylist(), table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True))
    by = lambda r: (-r[1] if r[1] is not None else -NO_ID, r[2] or "")
    own = sorted((r for r in rows if not r[0]), key=by)
    guest = min((r for r in rows if r[0]), key=by, default=None)
    out: dict[str, list] = {f.name: [] for f in FIELDS}
    texts = [r[2] or "" for r in own]
    prints = [fingerprint(t) for t in texts]
    after = guest[2] or "" if guest else (texts[0] if texts else "")
    after_print = fingerprint(after)
    for i, (_, doc_id, _) in enumerate(own):
        last = i + 1 == len(own)
        changed = edited(texts[i], after if last else texts[i + 1])
        own_print, changed_print, next_print = prints[i], fingerprint(changed), after_print if last else prints[i + 1]
        for name, value in zip(out, (doc_id, len(texts[i]), hashlib.sha256(changed.encode()).hexdigest(), f"{own_print:016x}", f"{changed_print:016x}", likeness(own_print, changed_print), likeness(own_print, next_print)), strict=True):
            out[name].append(value)
    return pa.Table.from_batches([batch_of(out, FIELDS)])


def permuted_tables(radius: int, blocks: int) -> list[int]:
    """The key mask of each table: every choice of all but `radius` of the blocks."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    part = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(blocks)]
    return [sum(part[i] for i in keep) for keep in combinations(range(blocks), blocks - radius)]


def near_fingerprints(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs (query, found, distance) of different fingerprints (long columns named `print`) within the radius.

    Both sides are reduced to distinct fingerprints first, so copies never multiply; membership is the
    input itself. A null fingerprint finds nothing.
    """
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in permuted_tables(radius, blocks)]
    masks = F.array(*[F.lit(m).cast("long") for m in signed])

    def keyed(df: DataFrame, name: str) -> DataFrame:
        one = df.where("print is not null").select(F.col("print").alias(name)).distinct()
        return one.select(name, F.posexplode(masks).alias("table", "mask")).select(name, "table", F.col(name).bitwiseAND(F.col("mask")).alias("key"))

    apart = F.bit_count(F.col("query").bitwiseXOR(F.col("found")))
    # merged, never broadcast: Spark sizes a side by its fingerprints, not by their keys in all tables
    pairs = keyed(queries, "query").join(keyed(prints, "found").hint("merge"), ["table", "key"]).where((F.col("query") != F.col("found")) & (apart <= radius))
    return pairs.select("query", "found", apart.cast("int").alias("distance")).distinct()


def neighbours(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Of every document whose id is divisible by 50: doc_id, fingerprint, n_near (other fingerprints of the table within the
    radius) and nearest (the least distance to one, else null). Null ids are not asked about."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t or "") for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "print"])

    prints = materialize(doc_columns(docs).mapInArrow(run, "doc_id long, print long"), "prints")
    asked = prints.where("doc_id % 50 = 0")
    near = near_fingerprints(asked, prints, radius).groupBy(F.col("query").alias("print")).agg(F.count("*").alias("n_near"), F.min("distance").alias("nearest"))
    return asked.join(near, "print", "left").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.coalesce("n_near", F.lit(0)).alias("n_near"), "nearest")


def fingerprint_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(documents(spark, sf_dir))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))
