"""Byte-level BPE through a global shuffle of distinct words.

Every block of documents (see common) takes its texts apart into pre-tokens and asks about each distinct one
once. The questions meet in buckets by a hash of the pre-token, where each distinct pre-token of the whole
corpus is encoded once; the ids go back to the blocks that asked. There every text is put together again by
the positions of its pre-tokens, and decoding joins the table of token bytes (one entry for each rank).

A pre-token of every document costs one question from each block, not one from each occurrence.

Defined results: null and empty texts have no ids. Repeated rows are encoded each; null ids stay null; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Blocks, batch_of, block_rows, documents, freed, pack_bytes, prepare, unpack_bytes, without_gc
from lodestone.llm.tokens import cut, spaced_pre_tokens

FILE = "byte_bpe_50k.tiktoken"
#: Blocks for each bucket: their distinct words take far less room than their texts.
WORDY = 4
QUESTION = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("payload", pa.binary())])
OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


@cache
def ranks(file: str) -> dict[bytes, int]:
    with open(file if "/" in file else public_tokenizers.path(file), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@cache
def piece_encoder(file: str):
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(file), special_tokens={})._encode_single_piece


@cache
def token_bytes(file: str) -> list[bytes]:
    """The table that decoding joins: the bytes of each id."""
    table = [b""] * (max(ranks(file).values()) + 1)
    for token, rank in ranks(file).items():
        table[rank] = token
    return table


def join_words(words: list[bytes]) -> bytes:
    return pack_bytes(np.array([len(words), *map(len, words)], np.uint32).tobytes() + b"".join(words))


def split_words(payload: bytes) -> list[bytes]:
    data = unpack_bytes(payload)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    ends = (np.cumsum(np.frombuffer(data, np.uint32, n, 4), dtype=np.int64) + 4 * (n + 1)).tolist()
    return [data[a:b] for a, b in zip([4 * (n + 1), *ends], ends, strict=False)]


def bucketed(words: set[bytes], buckets: int) -> list[tuple[int, list[bytes]]]:
    """The words of each bucket, both in ascending order."""
    out: dict[int, list[bytes]] = {}
    for w in sorted(words):
        out.setdefault(zlib.crc32(w) % buckets, []).append(w)
    return sorted(out.items())


def _chunks(texts: list[str]) -> tuple[list[list[str]], dict[str, list[str]], dict[str, list[str]]]:
    """Chunks of each text, and the pre-tokens of each distinct first and later chunk."""
    parts, distinct, _ = cut(texts)
    return parts, {c: spaced_pre_tokens("", c) for c in {p[0] for p in parts}}, {c: spaced_pre_tokens(" ", c) for c in distinct}


@without_gc
def _ask(table: pa.Table, buckets: int) -> pa.Table:
    _, heads, mids = _chunks(block_rows(table)[1])
    words = {w.encode() for chunks in (heads, mids) for pieces in chunks.values() for w in pieces}
    asked = bucketed(words, buckets)
    n = len(asked)
    return pa.Table.from_batches([batch_of({"bucket": [b for b, _ in asked], "block": [table.column("block")[0].as_py()] * n, "payload": [join_words(w) for _, w in asked]}, QUESTION)])


@without_gc
def _answer(table: pa.Table, file: str) -> pa.Table:
    encode = piece_encoder(file)
    known: dict[bytes, bytes] = {}
    answers = []
    for payload in table.column("payload"):
        words = split_words(payload.as_py())
        for w in words:
            if w not in known:
                known[w] = np.array(encode(w), np.uint32).tobytes()
        answers.append(join_words([known[w] for w in words]))
    return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "payload": pa.array(answers, pa.binary())})


@without_gc
def _assemble(docs: pa.Table, answers: pa.Table, file: str, buckets: int) -> pa.Table:
    ids, texts = block_rows(docs)
    parts, heads, mids = _chunks(texts)
    words = {w.encode() for chunks in (heads, mids) for pieces in chunks.values() for w in pieces}
    got = dict(zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist(), strict=True))
    coded: dict[str, bytes] = {}
    for bucket, own in bucketed(words, buckets):
        coded.update(zip([w.decode() for w in own], split_words(got[bucket]), strict=True))
    head = {c: b"".join(map(coded.__getitem__, p)) for c, p in heads.items()}
    mid = {c: b"".join(map(coded.__getitem__, p)) for c, p in mids.items()}
    out = [head[p[0]] + b"".join(map(mid.__getitem__, p[1:])) for p in parts]
    table = token_bytes(file).__getitem__
    decoded = [b"".join(map(table, np.frombuffer(x, np.uint32).tolist())) for x in out]
    return pa.Table.from_batches([batch_of({"doc_id": ids, "ids": out, "decoded": decoded}, OUT)])


def encode_decode(docs: DataFrame, file: str = FILE, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, ids as little-endian uint32 bytes, decoded bytes) of every row."""
    prepare(docs.sparkSession)
    blocks = Blocks(docs, block_bytes, ordered=False)
    buckets = -(-blocks.n // WORDY)
    asked = blocks.frame.groupBy("block").applyInArrow(lambda t: freed(_ask(t, buckets)), "bucket long, block long, payload binary")
    answers = asked.groupBy("bucket").applyInArrow(lambda t: freed(_answer(t, file)), "bucket long, block long, payload binary")
    both = blocks.frame.groupBy("block").cogroup(answers.groupBy("block"))
    return both.applyInArrow(lambda left, right: freed(_assemble(left, right, file, buckets)), "doc_id long, ids binary, decoded binary")


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(documents(spark, sf_dir))
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
