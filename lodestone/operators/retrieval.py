"""Vector retrieval and reciprocal-rank fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import VectorStoreConfig
from lodestone.functions import vectors as V
from lodestone.functions.joins import against_all

def checked_vectors(df: DataFrame, column: str, dimension: int, max_rows: int | None = None) -> DataFrame:
    """df, or ValueError if a vector has a wrong size, is not finite, or there are too many."""
    n, good = df.agg(F.count("*"), F.count_if(V.is_valid(F.col(column), dimension))).first()
    if good != n:
        raise ValueError(f"{n - good} vectors are not finite or not of dimension {dimension}")
    if max_rows is not None and n > max_rows:
        raise ValueError(f"{n} vectors exceed the capacity of {max_rows}")
    return df


def semantic_topk(queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool = True, blocks: int = 32) -> DataFrame:
    """(qid, doc_idx, sim, rank): exact cosine top k of (qid, q) against (doc_idx, v), both unit vectors.

    Each task keeps its k best of a query before anything is shuffled (WindowGroupLimit)."""
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "doc_idx")
    pairs = against_all(vectors, queries, "qid", blocks)
    if exclude_self:
        pairs = pairs.where("qid <> doc_idx")
    found = pairs.select("qid", "doc_idx", F.round(V.dot(F.col("q"), F.col("v")), 6).alias("sim"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def block_topk(queries: DataFrame, vectors: DataFrame, k: int, dimension: int, block_bytes: int = 4 << 20) -> DataFrame:
    """semantic_topk() without exclude_self, of checked vectors: blocks of both sides meet in tasks, where NumPy adds up the products.

    They are added in the order of the dimensions, so every cosine has the bits of V.dot(). A block keeps, of each query, all that may be among
    its k best: where rounding could go either way, both ways."""
    held = max(1, block_bytes // (8 * dimension))
    sides, n = {}, {"q": -(-queries.count() // held) or 1, "v": -(-vectors.count() // held) or 1}
    for df, key, column, own, other in ((queries, "qid", "q", "_q", "_v"), (vectors, "doc_idx", "v", "_v", "_q")):
        block = F.pmod(F.xxhash64(key), F.lit(n[column])).cast("int").alias(own)
        copies = F.explode(F.sequence(F.lit(0), F.lit(n[other[1:]] - 1))).alias(other)
        sides[column] = df.select(key, column, block).select("*", copies)

    def matrix(table, column):
        return table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)

    def run(left, right):
        right = right.take(pc.sort_indices(right, sort_keys=[("doc_idx", "ascending")], null_placement="at_start"))
        rows, places, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            q, v = matrix(left, "q"), np.ascontiguousarray(matrix(right, "v").T)
            step = max(1, (1 << 17) // v.shape[1])
            for a in range(0, len(q), step):
                part = q[a : a + step]
                total = np.zeros((len(part), v.shape[1]))
                product = np.empty_like(total)
                for d in range(dimension):
                    total += np.multiply(part[:, d, None], v[d], out=product)
                for i, sim in enumerate(total):
                    low, high = np.floor(sim * 1e6 + 0.499), np.floor(sim * 1e6 + 0.501)
                    least = np.partition(low, -k)[-k] if k < len(low) else -np.inf
                    sure = np.flatnonzero((low == least) & (high == least))[:k]  # ties go to the smaller index
                    kept = np.r_[np.flatnonzero((high >= least) & ((low != least) | (high != least))), sure]
                    rows.append(np.full(len(kept), a + i))
                    places.append(kept)
                    sims.append(sim[kept])
        qid = left.column("qid").take(pa.array(np.concatenate(rows)))
        doc_idx = right.column("doc_idx").take(pa.array(np.concatenate(places)))
        return pa.Table.from_arrays([qid, doc_idx, pa.array(np.concatenate(sims))], names=["qid", "doc_idx", "sim"])

    kinds = {"qid": queries.schema["qid"].dataType.simpleString(), "doc_idx": vectors.schema["doc_idx"].dataType.simpleString()}
    found = sides["q"].groupBy("_q", "_v").cogroup(sides["v"].groupBy("_q", "_v")).applyInArrow(run, f"qid {kinds['qid']}, doc_idx {kinds['doc_idx']}, sim double")
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "doc_idx")
    return found.withColumn("sim", F.round("sim", 6)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(queries: DataFrame, vectors: DataFrame, k: int, dimension: int, store: VectorStoreConfig | None = None, exclude_self: bool = False) -> DataFrame:
    """semantic_topk() of checked input: ValueError for k beyond 1..max_k, and for vectors of another dimension, that are not finite, or too many."""
    store = store or VectorStoreConfig()
    if not 1 <= k <= store.max_k:
        raise ValueError(f"k={k} is not within 1..{store.max_k}")
    checked_vectors(queries, "q", dimension)
    checked_vectors(vectors, "v", dimension, store.max_vectors)
    return semantic_topk(queries, vectors, k, exclude_self) if exclude_self else block_topk(queries, vectors, k, dimension)


WORDS = 8  # of 64 bits in a signature


def signatures(rows: DataFrame, column: str, dimension: int, seed: int = 42) -> DataFrame:
    """rows with `signature`, WORDS longs: on which side of as many random planes as they have bits the vector lies."""
    planes = np.random.default_rng(seed).standard_normal((64 * WORDS, dimension)).astype(np.float32)
    names = rows.columns
    at = names.index(column)

    def run(batches):
        for batch in batches:
            vectors = np.array(batch.column(at).to_pylist(), np.float32).reshape(batch.num_rows, -1)
            longs = np.packbits(vectors @ planes.T > 0, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.ascontiguousarray(longs[:, k])) for k in range(WORDS)]], names=[*names, *[f"s{k}" for k in range(WORDS)]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", s{k} long" for k in range(WORDS))
    return rows.mapInArrow(run, schema)


def lsh_topk(queries: DataFrame, vectors: DataFrame, k: int, share: float = 0.05, seed: int = 42) -> DataFrame:
    """Approximate top k by random hyperplanes: signatures of all vectors are compared bit by bit, and of each query the
    nearest 10 k and a `share` of all are ranked by their cosine.

    A comparison is WORDS xors in generated code instead of a sum over the dimension. Tables of buckets would
    meet nearly all pairs here: neighbours at a cosine of 0.3 share few bits in a row."""
    first = vectors.select(F.size("v")).first()
    if first is None:
        return semantic_topk(queries, vectors, k)
    near = 10 * k + int(share * vectors.count())
    asked = signatures(queries, "q", first[0], seed).select("qid", *[F.col(f"s{i}").alias(f"t{i}") for i in range(WORDS)])
    stored = signatures(vectors, "v", first[0], seed).select("doc_idx", *[f"s{i}" for i in range(WORDS)])
    apart = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(1, WORDS)), F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))))
    pairs = against_all(stored, asked, "qid").where("qid <> doc_idx").select("qid", "doc_idx", apart.alias("apart"))
    closest = Window.partitionBy("qid").orderBy("apart", "doc_idx")
    pairs = pairs.withColumn("near", F.row_number().over(closest)).where(F.col("near") <= near).select("qid", "doc_idx")
    found = pairs.join(queries, "qid").join(vectors, "doc_idx").select("qid", "doc_idx", F.round(V.dot(F.col("q"), F.col("v")), 6).alias("sim"))
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "doc_idx")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf(rankings: list[tuple[DataFrame, float]], k: int, rrf_k: int = 60) -> DataFrame:
    """(qid, doc_idx, score, rank): weighted reciprocal ranks of several rankings (qid, doc_idx, rank from 1), added up."""
    parts = [df.select("qid", "doc_idx", (F.lit(weight) / (F.lit(rrf_k) + F.col("rank"))).alias("s")) for df, weight in rankings]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    fused = union.groupBy("qid", "doc_idx").agg(F.round(F.sum("s"), 9).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_idx")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
