"""SimHash near-dedup through a Gray-order hierarchical index.

Distinct fingerprints are sorted by their Gray rank and cut into ranges; each range is a subtree of one index.
A node of the index holds the bits that all fingerprints below it share, less those its parent holds already. A search
walks down from the roots, adds up its differences from the bits of the nodes it meets, and drops a whole group as soon
as the sum exceeds the radius. Over the ranges stands one more tree, built on the driver from the shared bits of each
range (at most MOST_RANGES rows); every fingerprint walks it first and is sent to those earlier ranges that may hold a neighbour.
There, and within its own range, the walk goes on to leaves of LEAF fingerprints. Guests of a range come in lots of LOT.

A lot reports for each fingerprint only the least one it is connected with inside the lot, never all
pairs; stars over those edges give the components.

The operator takes other fingerprints as well, with a radius, a group number (size classes: only fingerprints of neighbouring
classes link) and a second, wide fingerprint that must be near, too. keep_one() uses these for five-word similarity: see there.

Defined results: null texts, empty texts and texts without words have the zero fingerprint and link like
any other. Repeated rows share a component. A null id is never a component's id unless the component has no
other, which then gets a null. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import HashMemo, distinct_of, doc_columns, documents, freed, materialize, mix, prepare
from lodestone.llm.graph import components

RADIUS = 2
WIDTH = 3
LEAF, FANOUT = 16, 8
#: Ranges: one for so many fingerprints, but at least LEAST_RANGES where they suffice, and at most MOST_RANGES.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 1 << 20, 64, 1024
LOT = 1 << 18  # guests of a range that are searched together
FRONTIER = 1 << 16  # pairs of a search and a node that are looked at together
#: Near duplicates: five-word shingles of similarity 0.8 or more. Fingerprints of distinct words within NEAR bits, and of
#: the shingles within NEAR_WIDE of 256 bits (38 are expected at 0.8). Sizes differ by a ratio of at most 1 / 0.8, which is CLASSES size classes.
NEAR_WORDS, NEAR, NEAR_WIDE, SIMILAR, CLASSES = 5, 6, 44, 0.8, 4


def fingerprint(text: str) -> int:
    """Unsigned: a bit is 1 if it is set in over half of the XXH64 hashes of the word shingles."""
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - WIDTH + 1)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) <= WIDTH:
        return digest(join(words), 42)
    ones = np.zeros(64, np.int64)
    step = 1 << 15
    for at in range(0, n, step):
        part = words[at : min(n, at + step) + WIDTH - 1]
        hashes = np.array([digest(join(w), 42) for w in zip(part, part[1:], part[2:])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the signed view of the fingerprint."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t or "") for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "fp"])
            freed()

    return doc_columns(docs).mapInArrow(run, "doc_id long, fp long")


_MEMO = HashMemo(3)
_MUL = np.uint64(0x9E3779B97F4A7C15)
WIDE = 4  # 64-bit words of a wide fingerprint
_TURNS = np.arange(WIDE, dtype=np.uint64) * _MUL


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def similarity_print(text: str) -> tuple[int, bytes, int]:
    """Fingerprint of a text's distinct words (A-Z lower-cased), wide fingerprint of its distinct five-word shingles (a shorter
    text is one), and size class by their number."""
    words = text.encode().lower().split()
    if not words:
        return 0, bytes(8 * WIDE), -2 * CLASSES
    hashes = _MEMO.hashes(words)
    n = max(1, len(words) - NEAR_WORDS + 1)
    shingles = hashes[:n].copy()
    for k in range(1, min(NEAR_WORDS, len(words))):
        shingles = mix(shingles * _MUL + hashes[k : k + n])
    shingles = distinct_of(shingles)
    wide = [majority(mix(shingles + m)) for m in _TURNS]
    return majority(distinct_of(hashes)), np.array(wide, np.uint64).tobytes(), int(log(len(shingles)) / -log(SIMILAR) * CLASSES)


def stamp(docs: DataFrame) -> DataFrame:
    """docs and the columns fp, wide and grp of similarity_print(), written once, with a row number uid: every reader sees the same rows and numbers."""
    prepare(docs.sparkSession)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [similarity_print(t or "") for t in batch.column(at).to_pylist()]
            prints = pa.array(np.array([f for f, _, _ in found], np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints, pa.array([w for _, w, _ in found], pa.binary()), pa.array([g for _, _, g in found], pa.int64())], names=[*names, "fp", "wide", "grp"])
            freed()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return materialize(docs.mapInArrow(run, f"{schema}, fp long, wide binary, grp long").withColumn("uid", F.monotonically_increasing_id()), "stamped")


def keep_one(docs: DataFrame) -> DataFrame:
    """The row of the least (doc_id, text) in each group of near duplicates, null ids last.

    Near duplicates have a five-word similarity of 0.8 or more, as their fingerprints tell it: candidates are fingerprints of
    distinct words within NEAR bits (a few edits in a text change few words but five shingles each), which link if their wide fingerprints
    of shingles are within NEAR_WIDE bits as well. Groups are what such links connect. docs must have no columns fp, wide, grp or uid."""
    rows = stamp(docs)
    elements = materialize(rows.groupBy("fp", "wide", "grp").agg(F.min("uid").alias("key")), "distinct-prints")
    member = components(near_edges(elements, NEAR, NEAR_WIDE, CLASSES, least_ranges=16))
    root_of = elements.join(member.select(F.col("u").alias("key"), F.col("v").alias("root")), "key", "left").select("fp", "wide", "grp", F.coalesce("root", "key").alias("root"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"), F.col("uid").alias("uid"))
    of_element = rows.groupBy("fp", "wide", "grp").agg(F.min(rank).alias("rank"))
    first = of_element.join(root_of, ["fp", "wide", "grp"]).groupBy("root").agg(F.min("rank").alias("rank")).select("rank.uid")
    return rows.join(first, "uid", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def signed(code: int) -> int:
    return code - (1 << 64) if code >> 63 else code


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order: the prefix parity of its bits."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Union:
    """Sets of 0..n-1 with the least member as root; whole arrays of pairs at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


class GrayIndex:
    """Hierarchical index over uint64 codes, sorted by (group, Gray rank).

    lows and highs: bits that all and any code below each entry have, for an index over ranges; codes themselves else.
    """

    def __init__(self, lows: np.ndarray, highs: np.ndarray, least: np.ndarray, most: np.ndarray, leaf: int = LEAF):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]] = []  # own bits, value, least and greatest group, entries a node; the leaves first
        self.tested = self.dropped = 0
        self.groups = (int(least.min()), int(most.max())) if len(least) else (0, 0)
        rows = [(lows, highs, least, most)]
        widths = [1]
        while len(rows[-1][0]) > FANOUT:
            width = leaf if len(rows) == 1 else FANOUT
            low, high, least, most = rows[-1]
            starts = np.arange(0, len(low), width)
            rows.append((np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)))
            widths.append(width)
        for k, (low, high, least, most) in enumerate(rows):
            own = ~(low ^ high)
            if k + 1 < len(rows):  # what the parent holds already is not held again
                above = ~(rows[k + 1][0] ^ rows[k + 1][1])
                own = own & ~np.repeat(above, widths[k + 1])[: len(own)]
            self.levels.append((own, low, least, most, widths[k]))

    def near(self, codes: np.ndarray, groups: np.ndarray, radius: int, apart: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place in codes, entry) within the radius and with groups at most `apart`, some at a time.

        For entries that are ranges: those that may hold such a code."""
        top = len(self.levels) - 1
        grouped = len(groups) > 0 and max(int(groups.max()), self.groups[1]) - min(int(groups.min()), self.groups[0]) > apart

        def stay(depth: int, query: np.ndarray, node: np.ndarray, sum_: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
            own, value, least, most, _ = self.levels[depth]
            sum_ = sum_ + np.bitwise_count((codes[query] ^ value[node]) & own[node])
            good = sum_ <= radius
            if grouped:
                of = groups[query]
                good &= (least[node] <= of + apart) & (most[node] >= of - apart)
            good = np.flatnonzero(good)
            self.tested += len(query)
            self.dropped += len(query) - len(good)
            return depth, query[good], node[good], sum_[good]

        step = max(1, FRONTIER // max(1, len(self.levels[top][0])))
        for at in range(0, len(codes) if len(self.levels[0][0]) else 0, step):
            query, node = (x.ravel() for x in np.meshgrid(np.arange(at, min(at + step, len(codes)), dtype=np.int32), np.arange(len(self.levels[top][0]), dtype=np.int32), indexing="ij"))
            waiting = [stay(top, query, node, np.zeros(len(query), np.uint8))]
            while waiting:  # the deepest first, so that little waits
                depth, query, node, sum_ = waiting.pop()
                if depth == 0:
                    yield query, node
                    continue
                width = self.levels[depth][4]
                each = max(1, FRONTIER // width)
                if len(query) > each:
                    waiting.append((depth, query[each:], node[each:], sum_[each:]))
                    query, node, sum_ = query[:each], node[:each], sum_[:each]
                below = (node[:, None] * np.int32(width) + np.arange(width, dtype=np.int32)).ravel()
                query, sum_ = np.repeat(query, width), np.repeat(sum_, width)
                if len(below) and below.max() >= len(self.levels[depth - 1][0]):
                    there = np.flatnonzero(below < len(self.levels[depth - 1][0]))
                    query, below, sum_ = query[there], below[there], sum_[there]
                waiting.append(stay(depth - 1, query, below, sum_))


def index_of(codes: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, GrayIndex]:
    """The order of the codes, and the index over them in that order."""
    order = np.lexsort((gray_rank(codes), groups))
    return order, GrayIndex(codes[order], codes[order], groups[order], groups[order])


ELEMENT = pa.schema([("range", pa.int64()), ("lot", pa.int64()), ("guest", pa.bool_()), ("key", pa.int64()), ("fp", pa.int64()), ("grp", pa.int64()), ("wide", pa.binary())])
ELEMENTS = "range long, lot long, guest boolean, key long, fp long, grp long, wide binary"


def _route(batches: Iterator[pa.RecordBatch], ranges: np.ndarray, tree: GrayIndex, radius: int, apart: int) -> Iterator[pa.RecordBatch]:
    """Every element as a guest of the earlier ranges that may hold a neighbour."""
    names = [f.name for f in ELEMENT]
    for batch in batches:
        own = np.searchsorted(ranges, batch.column("range").to_numpy())
        for query, entry in tree.near(batch.column("fp").to_numpy().view(np.uint64), batch.column("grp").to_numpy(), radius, apart):
            there = entry < own[query]
            rows = batch.take(pa.array(query[there]))
            yield pa.RecordBatch.from_arrays([pa.array(ranges[entry[there]], pa.int64()), pa.array(np.zeros(rows.num_rows, np.int64)), pa.array(np.ones(rows.num_rows, bool)), *[rows.column(c) for c in names[3:]]], names=names)


def _connect(table: pa.Table, radius: int, wide_radius: int | None, apart: int) -> tuple[np.ndarray, np.ndarray, GrayIndex]:
    """The keys of a lot, for each the least key it is connected with there, and the index that was searched. Members
    search among themselves in the first lot alone."""
    guest = table.column("guest").to_numpy(zero_copy_only=False)
    table = pa.concat_tables([table.filter(pa.array(~guest)), table.filter(pa.array(guest))]).combine_chunks()
    n = int((~guest).sum())
    keys, codes, groups = table.column("key").to_numpy(), table.column("fp").to_numpy().view(np.uint64), table.column("grp").to_numpy()
    wide = None
    if wide_radius is not None:
        wide = np.frombuffer(b"".join(table.column("wide").to_pylist()), np.uint64).reshape(len(keys), -1)
    order, index = index_of(codes[:n], groups[:n])
    sets = Union(len(keys))
    asking = np.arange(len(keys)) if table.column("lot")[0].as_py() == 0 else np.arange(n, len(keys))
    for query, entry in index.near(codes[asking], groups[asking], radius, apart):
        i, j = asking[query], order[entry]
        once = (i >= n) | (i < j)
        i, j = i[once], j[once]
        if wide is not None:
            close = np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1, dtype=np.int64) <= wide_radius
            i, j = i[close], j[close]
        sets.link(i, j)
    least = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(least, sets.root, keys)
    return keys, least[sets.root], index


def _edges(table: pa.Table, radius: int, wide_radius: int | None, apart: int) -> pa.Table:
    keys, least, _ = _connect(table, radius, wide_radius, apart)
    far = keys != least
    return pa.table({"u": pa.array(keys[far]), "v": pa.array(least[far])})


def lots(elements: DataFrame, radius: int, apart: int = 0, least_ranges: int = LEAST_RANGES, lot: int = LOT) -> DataFrame:
    """Members of each range and the guests that the tree over the ranges sends there, in lots."""
    spark = elements.sparkSession
    n = elements.count()
    ranges = max(1, min(least_ranges, n // 1024), min(MOST_RANGES, n // RANGE_ROWS))
    prefix = elements.withColumn("rank", F.col("fp"))
    for shift in (1, 2, 4, 8, 16, 32):
        prefix = prefix.withColumn("rank", F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", shift)))
    prefix = prefix.withColumn("rank", F.col("rank").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))  # in signed order
    dealt = prefix.repartitionByRange(ranges, "grp", "rank").withColumn("range", F.spark_partition_id().cast("long"))
    dealt = materialize(dealt.select("range", "key", "fp", "grp", "wide"), "ranges")
    # one row for each partition reaches the driver; small neighbours become one range
    shared = sorted(dealt.groupBy("range").agg(F.bit_and("fp"), F.bit_or("fp"), F.min("grp"), F.max("grp"), F.count("*")).collect())
    numbers, low, high, first, last, sizes = np.array([tuple(r) for r in shared], np.int64).reshape(-1, 6).T.copy()
    begins = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) * ranges // max(1, n), prepend=-1))
    if len(begins) < len(numbers):
        of = np.repeat(numbers[begins], np.diff(np.r_[begins, len(numbers)]))
        names = spark.createDataFrame(list(zip(numbers.tolist(), of.tolist(), strict=True)), "range long, whole long")
        dealt = dealt.join(F.broadcast(names), "range").select(F.col("whole").alias("range"), "key", "fp", "grp", "wide")
        numbers, low, high = numbers[begins], np.bitwise_and.reduceat(low, begins), np.bitwise_or.reduceat(high, begins)
        first, last = np.minimum.reduceat(first, begins), np.maximum.reduceat(last, begins)
    tree = GrayIndex(low.view(np.uint64), high.view(np.uint64), first, last, FANOUT)
    guests = materialize(dealt.mapInArrow(lambda it: _route(it, numbers, tree, radius, apart), ELEMENTS), "guests")
    members = dealt.select("range", F.lit(0).cast("long").alias("lot"), F.lit(False).alias("guest"), "key", "fp", "grp", "wide")
    many = {r["range"]: -(-r["n"] // lot) for r in guests.groupBy("range").agg(F.count("*").alias("n")).collect()}  # as many rows
    if max(many.values(), default=1) > 1:
        known = spark.createDataFrame(sorted(many.items()), "range long, lots long")
        guests = guests.join(F.broadcast(known), "range").withColumn("lot", F.pmod(F.xxhash64("key"), F.col("lots"))).select(*[f.name for f in ELEMENT])
        members = members.drop("lot").join(F.broadcast(known), "range", "left").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("lots", F.lit(1)) - 1))).select(*[f.name for f in ELEMENT])
    return members.unionByName(guests)


def near_edges(elements: DataFrame, radius: int = RADIUS, wide_radius: int | None = None, apart: int = 0, least_ranges: int = LEAST_RANGES, lot: int = LOT) -> DataFrame:
    """Edges (u, v) of keys that connect all elements within the radius.

    elements: a written table (key, fp, and, for a wide_radius, wide), distinct in its keys; with grp, only elements
    whose groups differ by at most `apart` link."""
    for name, kind in (("grp", "long"), ("wide", "binary")):
        if name not in elements.columns:
            elements = elements.withColumn(name, F.lit(0 if name == "grp" else None).cast(kind))
    dealt = lots(elements, radius, apart, least_ranges, lot)
    return dealt.groupBy("range", "lot").applyInArrow(lambda t: freed(_edges(t, radius, wide_radius, apart)), "u long, v long")


def pruning(elements: DataFrame, radius: int = RADIUS) -> DataFrame:
    """For each range: its members and guests, the pairs of a search and a node that were looked at, and those that were dropped there."""

    def run(table: pa.Table) -> pa.Table:
        keys, _, index = _connect(table, radius, None, 0)
        guests = int(np.count_nonzero(table.column("guest").to_numpy(zero_copy_only=False)))
        return pa.table({"range": [table.column("range")[0].as_py()], "members": [len(keys) - guests], "guests": [guests], "tested": [index.tested], "dropped": [index.dropped]})

    dealt = lots(elements.select("key", "fp", F.lit(0).cast("long").alias("grp"), F.lit(None).cast("binary").alias("wide")), radius)
    return dealt.groupBy("range", "lot").applyInArrow(run, "range long, members long, guests long, tested long, dropped long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    return components_of(materialize(fingerprints(docs), "fingerprints"))


def components_of(prints: DataFrame, least_ranges: int = LEAST_RANGES, lot: int = LOT) -> DataFrame:
    """(doc_id, fp, component_id) of every row of a written table (doc_id, fp)."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    member = components(near_edges(distinct.select(F.col("fp").alias("key"), "fp"), least_ranges=least_ranges, lot=lot))
    root_of = distinct.join(member.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = root_of.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = root_of.join(least, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
