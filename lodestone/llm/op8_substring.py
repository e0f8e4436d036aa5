"""Substring dedup by relative Lempel-Ziv parsing against every indexed reference block.

Reference blocks are ascending ranges of doc_id (see common). The hashes of all windows of WINDOW words meet
in buckets of the hash range, where every window learns the earliest block that holds it. A block then sends each stretch of
windows with one earlier block there, as words; equal stretches of all blocks are sent once. The reference block
factors a stretch greedily against the index of its own windows: it looks up the window at hand, compares word by word
with the first place that holds it, extends the match as far as both texts agree, and goes on at the factor's boundary,
with the first window that reaches beyond it. So no window that straddles two factors is missed. Stretches whose
source lies in their own block are factored there in the same way, against the places before them. Factors of WINDOW
words at least become duplicate spans; each has its source document and start.

A window sends one entry from each block that holds it, however often it stands there, and a stretch is parsed once for
all documents that share it. No word goes on the strength of a hash: words are compared. Two windows with one 64-bit
hash can only hide a repeat (among n distinct windows and r repeated ones a chance of about n * r / 2**64).

Defined results: windows are ordered by (doc_id, start), rows of one id by their text, null ids first. A null
text has no words. Shorter documents keep all words. An empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Blocks, HashMemo, batch_of, block_rows, block_table, distinct_of, documents, freed, materialize, mix, pack_bytes, pack_keys, prepare, unpack_bytes, unpack_keys, without_gc

WINDOW = 20
SEED = 11
_MEMO = HashMemo(SEED, 300_000)
_BASE = 0x9E3779B97F4A7C15
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
NONE = np.uint32(0xFFFFFFFF)
NO_ID = np.iinfo(np.int64).min
LOT = 16 << 20  # bytes of stretches that are parsed against a block in one task
SLICE = 4 << 20  # bytes of words that are unpacked together there
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source_doc", pa.int64()), ("source_start", pa.int64())]))
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", SPAN), ("kept", pa.string())])
ENTRY = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("payload", pa.binary())])
#: A stretch of a block: words once for each (source, key, check), its places as pairs (row, start). Factors, where they
#: are known, as (start in the stretch, words, source document, start there); those of the block itself in one row without a source.
STRETCH = pa.schema([("block", pa.int64()), ("source", pa.int64()), ("key", pa.int64()), ("check", pa.int64()), ("words", pa.binary()), ("places", pa.binary()), ("factors", pa.binary())])
FACTORED = pa.schema([("source", pa.int64()), ("key", pa.int64()), ("check", pa.int64()), ("factors", pa.binary())])


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long'}" for f in schema)


def window_hashes(words: list[bytes], width: int) -> np.ndarray:
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    part, size = _MEMO.hashes(words), 1  # of `size` words from each on; doubled, and added up to the width
    total, have = None, 0
    while True:
        if width & size:
            total = part if total is None else part[: len(words) - have - size + 1] * np.uint64(pow(_BASE, have, 1 << 64)) + total[size:]
            have += size
        if 2 * size > width:
            return mix(total)
        part = part[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + part[size:]
        size *= 2


class Windows:
    """The words of texts in a row, where each text begins and ends, how many windows it has, and the hash and place of each window."""

    def __init__(self, parts: list[list[bytes]], width: int):
        sizes = np.array([len(p) for p in parts], np.int64)
        self.words = [w for p in parts for w in p]
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.sizes = np.maximum(sizes - width + 1, 0)
        ends = np.cumsum(self.sizes)
        self.places = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begins - (ends - self.sizes), self.sizes)
        hashes = window_hashes(self.words, width)
        self.hashes = hashes[self.places] if len(self.places) else np.zeros(0, np.uint64)


class Reference(Windows):
    """The texts of a block: all words in a row, where each text begins, and the hash and place of each window."""

    def __init__(self, texts: list[str], width: int):
        super().__init__([t.encode().split() for t in texts], width)
        self.width = width
        self.text_ends = self.ends.tolist()

    def text_of(self, place: int) -> int:
        return bisect_right(self.text_ends, place)

    def common(self, words: list[bytes], at: int, end: int, place: int) -> int:
        """How many words from words[at] on, up to `end`, equal those from `place` on in its text."""
        limit = min(end - at, self.text_ends[self.text_of(place)] - place)
        same, step = 0, 2 * self.width
        while same < limit:
            step = min(step, limit - same)
            if words[at + same : at + same + step] == self.words[place + same : place + same + step]:
                same += step
                step *= 2
            elif step == 1:
                break
            else:
                step = (step + 1) // 2
        return same

    def factors(self, words: list[bytes], begin: int, end: int, found: list[int]) -> list[tuple[int, int, int]]:
        """Greedy factors (place in words, words, place here) of words[begin:end]; found: for the window at each place from begin on, where it first stands here, or -1."""
        out = []
        at = 0
        while at < len(found):
            if found[at] < 0:
                at += 1
                continue
            same = self.common(words, begin + at, end, found[at])
            if same < self.width:  # another window with the same hash
                at += 1
                continue
            out.append((begin + at, same, found[at]))
            at += same - self.width + 1
        return out

    @cached_property
    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes in ascending order, and where each first stands."""
        distinct, first = np.unique(self.hashes, return_index=True)
        return distinct, self.places[first]

    def first_places(self, hashes: np.ndarray) -> np.ndarray:
        """Where the window of each hash first stands, or -1."""
        distinct, first = self.index
        if not len(distinct):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(distinct, hashes), len(distinct) - 1)
        return np.where(distinct[at] == hashes, first[at], -1)


def _slices(distinct: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the sorted hashes: buckets are equal ranges of the upper 32 bits."""
    if not len(distinct):
        return []
    bucket = ((distinct >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[starts[1:], len(bucket)]
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(starts, ends, strict=True)]


@without_gc
def _send(table: pa.Table, width: int, buckets: int) -> pa.Table:
    distinct = distinct_of(Windows([t.encode().split() for t in block_rows(table)[1]], width).hashes)
    cuts = _slices(distinct, buckets)
    block = table.column("block")[0].as_py()
    return pa.Table.from_batches([batch_of({"bucket": [c[0] for c in cuts], "block": [block] * len(cuts), "payload": [pack_keys(distinct[a:b]) for _, a, b in cuts]}, ENTRY)])


@without_gc
def _find(table: pa.Table) -> pa.Table:
    """For each block's entries of a bucket: the earliest block with the same hash, or NONE for itself."""
    blocks = table.column("block").to_numpy()
    order = np.argsort(blocks, kind="stable")
    payloads = table.column("payload")
    arrays = [unpack_keys(payloads[int(i)].as_py()) for i in order]
    sizes = [len(a) for a in arrays]
    hashes = np.concatenate(arrays)
    owner = np.repeat(blocks[order].astype(np.uint32), sizes)
    rank = np.argsort(hashes, kind="stable")
    ordered = hashes[rank]
    head = np.r_[True, ordered[1:] != ordered[:-1]]
    source = owner[rank][np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))]
    source[head] = NONE
    answer = np.empty(len(hashes), np.uint32)
    answer[rank] = source
    ends = np.cumsum(sizes)
    out = {"bucket": table.column("bucket").to_numpy()[order], "block": blocks[order], "payload": [pack_bytes(answer[b - n : b].tobytes()) for n, b in zip(sizes, ends, strict=True)]}
    return pa.Table.from_batches([batch_of(out, ENTRY)])


@without_gc
def _stretches(docs: pa.Table, answers: pa.Table, width: int, buckets: int) -> pa.Table:
    """Stretches of a block's documents whose source is another block, and the factors of those whose source is this one."""
    block = docs.column("block")[0].as_py()
    ids, texts = block_rows(docs)
    here = Reference(texts, width)
    del texts
    distinct, first, inverse = np.unique(here.hashes, return_index=True, return_inverse=True)
    got = dict(zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist(), strict=True))
    of_hash = np.full(len(distinct), -1, np.int64)
    for bucket, a, b in _slices(distinct, buckets):
        part = np.frombuffer(unpack_bytes(got[bucket]), np.uint32)
        of_hash[a:b] = np.where(part == NONE, -1, part.astype(np.int64))
    source = of_hash[inverse]
    repeat = first[inverse]  # the first window here with the same hash
    own = np.where((source < 0) & (repeat != np.arange(len(repeat))), here.places[repeat] if len(repeat) else repeat, -1)
    rows: dict[tuple[int, int, int], list] = {}
    local: list[tuple] = []
    places: list[tuple[int, int]] = []
    ends = np.cumsum(here.sizes)
    for row in np.flatnonzero(here.sizes).tolist():
        span = slice(int(ends[row] - here.sizes[row]), int(ends[row]))
        begin, end, of = int(here.begins[row]), int(here.ends[row]), source[span]
        if (own[span] >= 0).any():
            for at, length, place in here.factors(here.words, begin, end, own[span].tolist()):
                text = here.text_of(place)
                places.append((row, at - begin))
                local.append((0, length, NO_ID if ids[text] is None else ids[text], place - int(here.begins[text])))
        if (of >= 0).any():
            edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
            for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
                if of[a] >= 0:
                    words = b" ".join(here.words[begin + a : begin + b + width - 1])
                    key = (int(of[a]), xxhash.xxh64_intdigest(words, 1) >> 1, xxhash.xxh64_intdigest(words, 2) >> 1)
                    if key not in rows:
                        rows[key] = [pack_bytes(words)]
                    rows[key].append((row, a))
    out: dict[str, list] = {f.name: [] for f in STRETCH}
    flat = lambda x: np.array(x, np.int64).tobytes()
    found = [(block, *key, value[0], flat(value[1:]), None) for key, value in rows.items()]
    if local:
        found.append((block, None, None, None, None, flat(places), flat(local)))
    for values in found:
        for name, value in zip(out, values, strict=True):
            out[name].append(value)
    return pa.Table.from_batches([batch_of(out, STRETCH)])


def _unpacked(packed: Iterable[bytes], size: int) -> Iterator[list[list[bytes]]]:
    """The words of stretches, about `size` bytes of them at a time."""
    some, held = [], 0
    for words in map(unpack_bytes, packed):
        some.append(words.split(b" "))
        held += len(words)
        if held >= size:
            yield some
            some, held = [], 0
    if some:
        yield some


@without_gc
def _parse(docs: pa.Table, asked: pa.Table, width: int, size: int = SLICE) -> pa.Table:
    """The factors of all stretches that name this block as their source. Words take many times their packed bytes: a slice of them is unpacked at a time."""
    out: dict[str, list] = {f.name: [] for f in FACTORED}
    if docs.num_rows and asked.num_rows:
        block = docs.column("block")[0].as_py()
        ids, texts = block_rows(docs)
        here = Reference(texts, width)
        del texts
        out["key"], out["check"] = asked.column("key").to_pylist(), asked.column("check").to_pylist()
        out["source"] = [block] * asked.num_rows
        for stretches in _unpacked((w.as_py() for w in asked.column("words")), size):
            windows = Windows(stretches, width)
            first = here.first_places(windows.hashes).tolist()
            at = 0
            for words, own in zip(stretches, windows.sizes.tolist(), strict=True):
                found = []
                for start, length, place in here.factors(words, 0, len(words), first[at : at + own]):
                    text = here.text_of(place)
                    found.append((start, length, NO_ID if ids[text] is None else ids[text], place - int(here.begins[text])))
                at += own
                out["factors"].append(np.array(found, np.int64).tobytes())
    return pa.Table.from_batches([batch_of(out, FACTORED)])


def without(text: bytes, spans: list[re.Match], hit: np.ndarray) -> str:
    """The text without the words that are hit and the white space after each."""
    out, at = [], 0
    edges = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0])).tolist()
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out.append(text[at : spans[a].start()])
        at = spans[b].start() if b < len(spans) else len(text)
    return b"".join([*out, text[at:]]).decode()


def span_lists(spans: list[np.ndarray]) -> pa.Array:
    """Rows (start, length, source_doc, source_start) of each document as SPAN: objects for each would outweigh the texts."""
    flat = np.concatenate(spans) if spans else np.zeros((0, 4), np.int64)
    offsets = np.cumsum([0, *map(len, spans)])
    fields = [pa.array(np.ascontiguousarray(flat[:, k]), mask=flat[:, k] == NO_ID if SPAN.value_type[k].name == "source_doc" else None) for k in range(4)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(SPAN.value_type)), type=SPAN)


@without_gc
def _remove(docs: pa.Table, factored: pa.Table, carry: tuple[str, ...], layout: bool) -> pa.Table:
    rows = block_table(docs)
    ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
    of_row: dict[int, list[tuple]] = {}
    for places, factors, whole in zip(factored.column("places"), factored.column("factors"), factored.column("source").is_valid().to_pylist(), strict=True):
        at = np.frombuffer(places.as_py(), np.int64).reshape(-1, 2).tolist()
        found = np.frombuffer(factors.as_py(), np.int64).reshape(-1, 4).tolist()
        pairs = ((p, f) for p in at for f in found) if whole else zip(at, found, strict=True)
        for (row, start), (offset, length, doc, source_start) in pairs:
            of_row.setdefault(row, []).append((start + offset, length, doc, source_start))
    out: dict[str, list] = {f.name: [] for f in OUT if f.name != "spans"}
    spans_of: list[np.ndarray] = []
    for row, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
        own = (text or "").encode().split()
        spans = sorted(of_row.pop(row, ()))
        spans_of.append(np.array(spans, np.int64).reshape(-1, 4))
        hit = np.zeros(len(own), bool)
        for start, length, _, _ in spans:
            hit[start : start + length] = True
        removed = int(hit.sum())
        if layout:
            kept = without(text.encode(), list(_WORD.finditer(text.encode())), hit) if removed else text
        else:
            kept = b" ".join([w for w, gone in zip(own, hit.tolist(), strict=True) if not gone] if removed else own).decode()
        values = (doc_id, len(own), removed, kept)
        for name, value in zip(out, values, strict=True):
            out[name].append(value)
    done = pa.table([span_lists(spans_of) if f.name == "spans" else pa.array(out[f.name], f.type) for f in OUT], schema=OUT)
    for c in carry:
        done = done.append_column(c, rows.column(c))
    return done


def remove_repeats(docs: DataFrame, width: int = WINDOW, block_bytes: int = 8 << 20, carry: tuple[str, ...] = (), layout: bool = False, lot: int = LOT) -> DataFrame:
    """doc_id, n_words, n_removed, spans (start, length, source_doc, source_start) and kept (words joined by a space) of every row.

    carry: further columns of docs to return; their names must differ from these. layout: kept is the text itself, a null
    too, without the words that go and the white space after each.
    """
    prepare(docs.sparkSession)
    blocks = Blocks(docs, block_bytes, carry)
    buckets, frame = blocks.n, blocks.frame
    sent = frame.groupBy("block").applyInArrow(lambda t: freed(_send(t, width, buckets)), "bucket long, block long, payload binary")
    found = sent.groupBy("bucket").applyInArrow(lambda t: freed(_find(t)), "bucket long, block long, payload binary")
    asked = frame.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(lambda left, right: freed(_stretches(left, right, width, buckets)), ddl(STRETCH))
    asked = materialize(asked, "stretches")
    distinct = asked.where("source is not null").groupBy("source", "key", "check").agg(F.first("words").alias("words"))
    distinct = distinct.withColumnRenamed("source", "block")
    # a reference block that very many stretches name is parsed against in lots; at most one row for LOT bytes of stretches
    hot = asked.where("source is not null").groupBy(F.col("source").alias("block")).agg(F.sum(F.octet_length("words")).alias("size")).where(F.col("size") > lot)
    hot = materialize(hot.select("block", F.expr(f"size div {lot} + 1").alias("lots")), "hot")
    at, references = ["block"], frame
    if not hot.isEmpty():
        at = ["block", "lot"]
        distinct = distinct.join(F.broadcast(hot), "block", "left").withColumn("lot", F.pmod("key", F.coalesce("lots", F.lit(1))))
        hot = hot.select(F.col("block").alias("block"), F.col("lots").alias("copies"))  # columns of its own: a cogroup takes one that both sides share for ambiguous
        references = frame.join(F.broadcast(hot), "block", "left").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1)))
    factored = references.groupBy(*at).cogroup(distinct.groupBy(*at)).applyInArrow(lambda left, right: freed(_parse(left, right, width)), ddl(FACTORED))
    remote = asked.select("block", "source", "key", "check", "places").join(factored, ["source", "key", "check"]).select("block", "source", "places", "factors")
    local = asked.where("source is null").select("block", "source", "places", "factors")
    both = frame.groupBy("block").cogroup(remote.unionByName(local).groupBy("block"))
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,length:long,source_doc:long,source_start:long>>, kept string"
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return both.applyInArrow(lambda left, right: freed(_remove(left, right, carry, layout)), schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
