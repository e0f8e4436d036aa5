"""Helpers that the operators of this subpackage share.

Document blocks
---------------
Operators that need an answer about a text's words from the whole corpus cut
the documents into *blocks*: contiguous ranges of doc_id of about
``block_bytes`` of text. A block travels through one shuffle as compressed
Arrow batches, and asks its questions in packed rows dealt by a hash of the
word (or window), one row for each pair of block and hash bucket. A word that
stands in every document is thus asked about once a block, so no hot key can
gather more than one entry from each block.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
DOC_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


#: Rows of an Arrow batch at most: texts are long, and a batch stands in the JVM's and the worker's memory at once.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package where the session runs from another folder, and keep Arrow batches of texts small."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(size)) > BATCH_ROWS:
        spark.conf.set(size, BATCH_ROWS)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, paths]) if paths else ROOT


try:
    _trim, _mallopt = ctypes.CDLL("libc.so.6").malloc_trim, ctypes.CDLL("libc.so.6").mallopt
except (OSError, AttributeError):  # another C library

    def _trim(_pad: int) -> int:
        return 0

    def _mallopt(_what: int, _value: int) -> int:
        return 0


def freed(result=None):
    """result, after memory that is no longer used went back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    _trim(0)
    return result


def keeps_memory(f):
    """f, while which the arrays it drops stay with the process for the next ones: the system clears each page anew. freed() gives them back after it."""

    @wraps(f)
    def run(*args, **kwargs):
        _mallopt(-1, 512 << 20)  # M_TRIM_THRESHOLD
        _mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        try:
            return f(*args, **kwargs)
        finally:
            _mallopt(-1, 64 << 20)  # as glibc sets both itself after large arrays
            _mallopt(-3, 32 << 20)

    return run


def without_gc(f):
    """f, with the search for reference cycles put off until it ends: it makes millions of objects and no cycle."""

    @wraps(f)
    def run(*args, **kwargs):
        gc.disable()
        try:
            return f(*args, **kwargs)
        finally:
            gc.enable()

    return run


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Where it is unset, a local session (tests) gets one of its own; a cluster's executors share no such folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage in a way that survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.format(fmt).save(path)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path)


def discard(df: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_columns(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, with fixed types; other columns may have any names and types."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, elementwise."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def distinct_of(values: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order, by sorting: faster than np.unique(), which fills a hash table."""
    if not len(values):
        return values
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]]


class HashMemo(dict):
    """bytes -> XXH64 with a seed; forgets everything when it holds `limit` words."""

    def __init__(self, seed: int, limit: int = 150_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def pack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys: the differences' bytes by their place."""
    return pack_bytes(np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unpack_bytes(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts, most of which are small, as bytes by their place."""
    return pack_bytes(np.ascontiguousarray(counts.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unpack_bytes(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def batch_of(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def weights(rows: DataFrame, starts: np.ndarray) -> np.ndarray:
    """The sum of the column size of rows (id, size) from each start up to the next; one row for each reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(starts), np.int64)
        for batch in batches:
            np.add.at(total, np.searchsorted(starts, batch.column(0).to_numpy(), side="right") - 1, batch.column(1).to_numpy())
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(here, pa.int64()), "size": pa.array(total[here], pa.int64())})

    out = np.zeros(len(starts), np.int64)
    for r in rows.mapInArrow(run, "at long, size long").groupBy("at").agg(F.sum("size").alias("size")).collect():
        out[r["at"]] = r["size"]
    return out


def range_edges(docs: DataFrame, bytes_per_part: int) -> list[int]:
    """Ascending edges that cut the ids that are not null into ranges of about so many bytes; one for each range but the last.

    Ids are counted in bins of even width, about eight for a range, and bins that are too heavy in narrower ones, down to one id."""
    return _edges(docs, bytes_per_part, *sums(docs)[2:])


def sums(docs: DataFrame) -> tuple:
    """Bytes of all texts, of those without an id; least and greatest id, and the bytes of rows with one."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    has = F.col("doc_id").isNotNull()
    got = docs.agg(F.sum(size), F.sum(F.when(~has, size)), F.min("doc_id"), F.max("doc_id"), F.sum(F.when(has, size + 16))).first()
    return got[0] or 0, got[1] or 0, got[2], got[3], got[4] or 0


def _edges(docs: DataFrame, bytes_per_part: int, low: int | None, high: int | None, total: int) -> list[int]:
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"))
    if low is None or total <= bytes_per_part:
        return []
    width = max(1, (high - low + 1) * bytes_per_part // (8 * total))
    first, last = ((x // width if x >= 0 else -(-x // width)) for x in (low, high))  # as div cuts: towards zero
    starts = [max(low, k * width if k > 0 else (k - 1) * width + 1) for k in range(first, last + 1)]
    sizes = [0] * len(starts)
    for r in rows.groupBy(F.expr(f"id div {width}L").alias("at")).agg(F.sum("size").alias("size")).collect():  # about eight rows for each range
        sizes[r["at"] - first] = r["size"]
    while True:
        ends = [*starts[1:], high + 1]
        narrow = [min(e - s, -(-8 * size // bytes_per_part)) if 2 * size > bytes_per_part else 1 for s, e, size in zip(starts, ends, sizes, strict=True)]
        if max(narrow) == 1:
            break
        starts = [s + (e - s) * k // n for s, e, n in zip(starts, ends, narrow, strict=True) for k in range(n)]
        sizes = weights(rows, np.array(starts, np.int64)).tolist()
    edges, held = [], 0
    for start, size in zip(starts, sizes, strict=True):
        if held and held + size > bytes_per_part:
            edges.append(start)
            held = 0
        held += size
    return edges


class Blocks:
    """Documents in blocks.

    frame: (block long, payload binary), dealt by block. n: number of blocks,
    at least 1. Null ids go to the first blocks, repeated rows stay in one block. ordered: blocks ascend by doc_id;
    else null ids are dealt to as many blocks as they fill, by their text.
    carry: further columns that travel with the documents.
    """

    def __init__(self, docs: DataFrame, block_bytes: int = 8 << 20, carry: tuple[str, ...] = (), ordered: bool = True):
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in carry])
        docs = doc_columns(docs)
        self.size, none, *ids = sums(docs)
        edges = np.array(_edges(docs, block_bytes, *ids), np.int64)
        first = 1 if ordered else max(1, round(none / block_bytes))
        self.n = len(edges) + first
        self.frame = rows.mapInArrow(lambda it: _pack(it, edges, first=first), "block long, payload binary")


def _pack(batches: Iterator[pa.RecordBatch], edges: np.ndarray, hold: int = 32 << 20, first: int = 1) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("block", pa.int64()), ("payload", pa.binary())])
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
        at = np.searchsorted(edges, ids, side="right") + (first - 1)
        if first > 1:
            none = np.flatnonzero(table.column("doc_id").is_null().to_numpy())
            at[none] = [xxhash.xxh64_intdigest(table.column("text")[int(k)].as_py() or "") % first for k in none]
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[order])) + 1
        blocks, payloads = [], []
        for rows in np.split(order, cuts):
            part = table.take(pa.array(rows)).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(part)
            blocks.append(int(at[rows[0]]))
            payloads.append(sink.getvalue().to_pybytes())
        return batch_of({"block": blocks, "payload": payloads}, schema)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= hold:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def block_table(table: pa.Table) -> pa.Table:
    """The documents of one block by (doc_id, text), null ids first and null texts as empty ones."""
    docs = pa.concat_tables([pa.ipc.open_stream(payload.as_buffer()).read_all() for payload in table.column("payload")]).combine_chunks()
    ids, texts = docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] or ""))
    return docs.take(pa.array(order, pa.int64()))


def block_rows(table: pa.Table) -> tuple[list[int | None], list[str]]:
    """Ids and texts of block_table()."""
    docs = block_table(table)
    return docs.column("doc_id").to_pylist(), [t or "" for t in docs.column("text").to_pylist()]
