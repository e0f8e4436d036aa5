"""Token-id output as ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents come in blocks, ascending ranges of doc_id; up to FILE_BLOCKS neighbouring blocks make one file, whose rows ascend by
(doc_id, text), as files do by their names. A file has several stripes: they can be read in parallel, stripes and rows of an index
stride are skipped by their least and largest ids, and single ids by the Bloom filters.

Columns of a file: block, row (its place in the block), doc_id, n_tokens, start (ids before it in the block), ids.

Defined results: a null text is empty and has the end id alone; null ids come first; repeated rows are
written each; an empty table writes no row. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Blocks, block_rows, documents, freed, prepare, shared_folder, without_gc
from lodestone.llm.tokens import encoder

FILE = "byte_bpe_50k.json"
END = 0
ROW = "block long, row int, doc_id long, n_tokens int, start long, ids array<int>"
ROW_INDEX = 1000
STRIPE = 8 << 20
#: Blocks of a file, and files that are wanted at least before a file gets more than one.
FILE_BLOCKS, LEAST_FILES = 16, 48


@without_gc
def _encode_block(table: pa.Table, file: str, end: int) -> pa.Table:
    ids, texts = block_rows(table)
    tail = np.array([end], np.uint16).tobytes()
    coded = [x + tail for x in encoder(file).encode(texts)]
    sizes = np.array([len(x) // 2 for x in coded], np.int64)
    ends = np.cumsum(sizes)
    values = np.frombuffer(b"".join(coded), np.uint16).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values))
    block = table.column("block")[0].as_py()
    return pa.table({"block": pa.array([block] * len(ids), pa.int64()), "row": pa.array(range(len(ids)), pa.int32()), "doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(sizes, pa.int32()), "start": pa.array(ends - sizes, pa.int64()), "ids": lists})


def _encode_blocks(batches: Iterator[pa.RecordBatch], file: str, end: int) -> Iterator[pa.RecordBatch]:
    """Rows of ascending blocks, encoded block by block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and a < b and held[0].column("block")[0].as_py() != blocks[a]:
                yield from _encode_block(pa.Table.from_batches(held), file, end).to_batches()
                held = []
                freed()
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield from _encode_block(pa.Table.from_batches(held), file, end).to_batches()


def write_orc(docs: DataFrame, path: str, file: str = FILE, end: int = END, block_bytes: int = 8 << 20) -> None:
    """Encode every text of docs and write the ids, with `end` after each document, below path."""
    prepare(docs.sparkSession)
    blocks = Blocks(docs, block_bytes)
    each = min(FILE_BLOCKS, max(1, blocks.n // LEAST_FILES))
    dealt = blocks.frame.repartitionById(-(-blocks.n // each), F.expr(f"cast(block div {each} as int)")).sortWithinPartitions("block")
    coded = dealt.mapInArrow(lambda it: _encode_blocks(it, file, end), ROW)
    options = {"compression": "snappy", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(ROW_INDEX), "orc.stripe.size": str(STRIPE)}
    coded.write.options(**options).orc(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROW).orc(path)


def starts(rows: DataFrame) -> DataFrame:
    """(block, before): ids in all blocks before each; one row a block."""
    totals = rows.groupBy("block").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    return totals.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))


def checksums(rows: DataFrame) -> DataFrame:
    """block, doc_id, start (in the block), n_tokens and the crc32 of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values = lists.flatten().to_numpy().astype("<u4").tobytes()
            cuts = (lists.offsets.to_numpy() - lists.offsets[0].as_py()) * 4 if len(lists) else []
            crc = [zlib.crc32(values[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("doc_id"), batch.column("start"), batch.column("n_tokens").cast(pa.int64()), pa.array(crc, pa.int64())], names=["block", "doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("block", "doc_id", "start", "n_tokens", "ids").mapInArrow(run, "block long, doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-orc")
    write_orc(documents(spark, sf_dir), path)
    rows = read_orc(spark, path)
    return checksums(rows).join(starts(rows), "block").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
