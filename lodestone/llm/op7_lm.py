"""LM scoring: online logistic context mixing over hashed-context bit predictors.

A text is a row of chunks (a word and its space, the last one with the end). A chunk is coded in up to two parts, bit
by bit, and each bit's probability is mixed from the predictions of several contexts.

*Word flag.* The context is a hash of the two chunks before. If training met it, the chunk it met there most often is
the candidate, and one bit says whether the text goes on with it; a hit codes the whole chunk. Its predictors are the
candidate's log odds and a constant. So a passage that training has seen costs about a bit a word or less.
*Letters.* Otherwise the chunk's symbols, its UTF-8 bytes and an end, walk down a fixed binary code, short for frequent
letters. Each step is one bit, predicted by the counts of zeros and ones that training met at that node in each of three
contexts: the last two bytes, the last four, the word so far.

*Mixing.* The predictors' log odds are summed with weights and squashed. A gate chooses the set of weights: for letters
by the place in the chunk and the step, for flags by how often training met the context and how many flags just before
were hits. After every bit each weight of the set moves by RATE x error x input. A last stage refines the mixed
probability: for each gate and each band of confidence it follows how often the likelier bit was right, after every
bit as well, and is averaged with the mix. Weights and bands begin with START in every text and, so that texts run side by
side, anew after each SEGMENT bits of a long one. Total bits add up the log2 losses: a text's score depends on the trained counts
and on itself alone.

*Counts* come through the exchange of blocks (see common). A block sends each distinct pair of a context and what follows
it once, with its count there, to a bucket by the context; the bucket adds up the blocks and tells each block the log odds along
the walks, or whether the chunk is the candidate, and how sure that is. A context in every document costs one entry a
symbol from each block. Contexts of two and four bytes are keyed as they are, the word so far and two
chunks by bits of a hash whose number grows with the text, and a chunk after them by 12 bits of its hash. Nothing has a fixed size.
For a text that training counted, the flag's candidate is judged without the place itself (a tie is a miss), so
its score, too, says what the rest of the corpus knows of it; counts of letters include it.

The base score is an add-one unigram model over words. Its counts come through the same exchange: a word
costs one entry from each block.

Defined results: a null text is empty: the end alone. A null id counts as the text ''. Repeated rows count and
are scored each. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import repeat
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Blocks, batch_of, block_rows, documents, freed, keeps_memory, materialize, mix, pack_bytes, pack_counts, pack_keys, prepare, unpack_bytes, unpack_counts, unpack_keys, without_gc
from lodestone.llm.op4_bpe import join_words, split_words

CONTEXTS = 3
SYMBOL = 9  # bits of a symbol
SCALE = 1 / 16  # of the int8 log odds
LIMIT = 9.0
SEGMENT = 1 << 13  # bits of a text that share their weights
BASE = 0xD1B54A32D192ED03  # of the hash of the word so far
INPUTS = 4  # of the mixer: three contexts and a constant; a flag's odds, a constant and two zeros
TAG = 12  # bits of a chunk after its context
FLAG = 8  # the first gate of flags: eight gates of letters come before
GATES = FLAG + 12
RATE = 0.01
BANDS = 24  # of confidence, half a nat each
BAND_RATE = 0.03
#: Weights that each text begins with: of letters (first step of a symbol, later ones), of flags.
START = ((0.25, 0.45, 0.45, 0.0), (0.35, 0.4, 0.35, 0.0), (1.0, 0.0, 0.0, 0.0))
FEW = 31
FLAGS = 1024  # codes of a flag and its streak
BATCH_BITS = 16 << 20  # mixed side by side
LANES = 1 << 14  # side by side at most
STEPS = 17 << 5  # of a lane whose rows are looked up together; no power of two, as lanes would share lines of the cache
GATE = 31  # bits of a gate in an item
ZERO = 128  # of an item: the bit was 0
#: Sixteenths of the constant's log odds against the bit that was, by an item's last byte: letters have a constant.
CONSTANT = np.array([(16 if kind & ZERO else -16) if kind & GATE < FLAG else 0 for kind in range(256)], np.int8)
END_WORD = b"\n"  # no word has a line feed
HELD_OUT = (7, 2)
#: The letters that get short codes, by falling frequency.
FREQUENT = b" enthairosdulc.gb,fwy\xc3m-vpkqzxj\n\xa9ETAISONHRDLCMUWFGBPVKYJXQZ0123456789;:'\"!?()&*%$#|\xa8\xb1\xb3\xad\xa1\xbc\xa4\xb6\x9f\xaa\xa7"


@cache
def code() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Steps of each of the 257 symbols (256: end), where its walk begins, and the nodes (0 to 255) and bits of all walks in a row."""
    rank = {b: k for k, b in enumerate(FREQUENT)}
    weight = [(3 if s == 32 else 1) / (12.0 + rank.get(s, 150)) ** 3 for s in range(257)]
    heap: list[tuple[float, int]] = [(w, s) for s, w in enumerate(weight)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    fresh = 257
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i], parent[j] = (fresh, 0), (fresh, 1)
        heapq.heappush(heap, (a + b, fresh))
        fresh += 1
    sizes, nodes, bits = [], [], []
    for s in range(257):
        walk, at = [], s
        while at in parent:
            at, bit = parent[at]
            walk.append((at, bit))
        sizes.append(len(walk))
        nodes += [node for node, _ in reversed(walk)]
        bits += [bit for _, bit in reversed(walk)]
    steps = np.array(sizes, np.int64)
    return steps, np.cumsum(steps) - steps, np.array(nodes, np.int64) - 257, np.array(bits, np.uint8)


@cache
def code_order() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rank of each symbol among all walks in ascending order, the symbol of each rank, and the steps that the walks of two ranks share."""
    steps, begin, _, bits = code()
    walks = [bits[a : a + n].tolist() for a, n in zip(begin.tolist(), steps.tolist(), strict=True)]
    symbols = np.array(sorted(range(len(walks)), key=walks.__getitem__), np.int64)
    shared = np.zeros((len(walks), len(walks)), np.int8)
    for k, s in enumerate(symbols.tolist()):  # of neighbours; the others share the least of what lies between
        if k:
            a, b = walks[symbols[k - 1]], walks[s]
            shared[:k, k] = np.minimum(shared[:k, k - 1], next(i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y))
        shared[k, k] = len(walks[s])
    rank = np.empty(len(walks), np.int64)
    rank[symbols] = np.arange(len(walks))
    return rank, symbols, shared


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT[0] == HELD_OUT[1]


def chunks_of(text: str) -> list[str]:
    """The text cut after each space. A chunk is written without its space, the last one with a space for the end."""
    parts = text.split(" ")
    parts[-1] += " "
    return parts


def symbols_of(names: pa.Array, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all chunks in a row, each with its space or (last) end, and where each chunk begins."""
    if not isinstance(names, pa.LargeStringArray):
        names = names.cast(pa.large_string())
    offsets = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    data = np.frombuffer(names.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ends = np.cumsum(np.diff(offsets) + 1)
    symbols = np.empty(int(ends[-1]), np.int16)
    own = np.ones(len(symbols), bool)
    own[ends - 1] = False
    symbols[own] = data
    symbols[ends - 1] = np.where(last, 256, 32)
    return symbols, np.r_[0, ends[:-1]]


def edges_of(symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree of chunks, of which those that begin alike stand together: where its edges, the symbols after
    different beginnings, first stand, the edge of each symbol, and each symbol's place in its chunk."""
    n = len(symbols)
    sizes = np.diff(np.r_[begins, n])
    every = np.arange(n, dtype=np.int32)
    begin = np.repeat(begins.astype(np.int32), sizes)
    place = every - begin
    back = np.repeat(np.r_[0, sizes[:-1]].astype(np.int32), sizes)  # to the same place in the chunk before
    same = place < back
    same &= symbols[every - back] == symbols
    new = np.maximum.accumulate(np.where(same, np.int32(-1), every)) >= begin
    del same, back, begin
    edge = np.cumsum(new, dtype=np.int32)
    edge -= 1
    column = np.argsort(place.astype(np.uint16) if place.max() < 1 << 16 else place, kind="stable")
    since = np.maximum.accumulate(np.where(new[column], every, np.int32(0)))
    of = np.empty(n, np.int32)
    of[column] = edge[column[since]]
    return np.flatnonzero(new), of, place


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in ascending order, and the number of each key among them."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    return keys[first], number


def pairs_of(symbols: np.ndarray, at: np.ndarray, place: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of CONTEXTS the pairs (what stands before a symbol in its chunk, the symbol) at the places `at`, as numbered() keys:
    the context's number and value, and in the lowest SYMBOL bits the rank of the symbol's walk."""
    after = symbols.astype(np.uint64)
    after += np.uint64(1)  # 0: nothing
    inside = place[at]
    own = code_order()[0].astype(np.uint64)[symbols[at]]

    def keys(tag: int, value: np.ndarray) -> np.ndarray:
        value = value << np.uint64(SYMBOL)
        value |= np.uint64(tag << 62)
        value |= own
        return value

    value = np.zeros(len(at), np.uint64)
    for k in range(1, 5):
        x = after.take(at - k, mode="clip")
        x[inside < k] = 0
        x <<= np.uint64(SYMBOL * (k - 1))
        value |= x
    four, number = numbered(keys(1, value))
    del value, x, inside
    two, shorter = numbered(four & np.uint64((1 << 3 * SYMBOL) - 1))  # the last two bytes of four
    yield two, shorter[number]
    yield four, number
    del two, shorter, four, number
    # the word so far: what stands since the chunk's begin or a line feed, as the difference of two sums of powers
    every = np.arange(len(symbols), dtype=np.int32)
    start = every - place
    feed = symbols == 10
    if feed.any():
        line = np.maximum.accumulate(np.where(feed, every, np.int32(-1))) + 1
        np.maximum(start[1:], line[:-1], out=start[1:])
        del line
    every -= start
    power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(every.max()), BASE, np.uint64)])
    after *= power[every]
    sums = np.cumsum(after, dtype=np.uint64)
    sums -= after
    word = mix(sums[at] - sums[start[at]])
    del sums, after, every, start
    word >>= np.uint64(64 - 4 - bits)
    yield numbered(keys(2, word))


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of ascending keys by (bucket of the context, key), and (bucket, from, to) in that order."""
    bucket = mix(keys >> np.uint64(SYMBOL)) % np.uint64(buckets)
    if buckets < 1 << 16:
        bucket = bucket.astype(np.uint16)  # sorted by radix
    order = np.argsort(bucket, kind="stable")
    cuts = [0, *np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets)).tolist()]
    return order, [(b, x, y) for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]


def walk_odds(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ascending distinct keys of whole contexts, with their counts: steps of each, and the log odds of the
    bits of all walks in a row, as int8 sixteenths."""
    steps, begin, _, bits = code()
    _, symbols, shared = code_order()
    rank = (keys & np.uint64((1 << SYMBOL) - 1)).astype(np.int64)
    own = symbols[rank]
    size = steps[own]
    start = np.cumsum(size) - size
    context = keys >> np.uint64(SYMBOL)
    begins = np.r_[True, context[1:] != context[:-1]]
    out = np.repeat(_odds(counts, counts), size)  # of a context that one symbol follows: the same at each step
    # symbols of a context ascend by their walks: those that pass a node stand together
    left = np.flatnonzero(~(begins & np.r_[begins[1:], True]))
    rank, walk, start, size, counts = rank[left], begin[own[left]], start[left], size[left], counts[left].astype(np.float64)
    alike = np.where(begins[left], -1, shared[np.r_[0, rank[:-1]], rank])
    step = 0
    while len(rank):
        first = np.flatnonzero(alike < step)
        bit = bits[walk + step]
        many = np.diff(np.r_[first, len(alike)])
        odds = np.repeat(_odds(np.add.reduceat(counts * bit, first), np.add.reduceat(counts, first)), many)
        out[start + step] = np.where(bit > 0, odds, -odds)
        step += 1
        on = size > step  # a walk that ends parts its neighbours, which share fewer steps with it
        rank, walk, start, size, counts, alike = (x[on] for x in (rank, walk, start, size, counts, alike))
    return steps[own], out


def _odds(ones: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.log((ones + 0.1) / (whole - ones + 0.1)) / SCALE), -127, 127).astype(np.int8)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, and so on for each pair; as int32."""
    ends = np.cumsum(sizes)
    out = np.repeat((starts - (ends - sizes)).astype(np.int32), sizes)
    out += np.arange(len(out), dtype=np.int32)
    return out


def context_bits(size: int) -> int:
    """Bits of a context of two chunks for so many bytes of text (a word so far has four more): few contexts share a key."""
    return min(49, max(32, size.bit_length() + 6))


_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def follow_keys(hashes: np.ndarray, begins: np.ndarray, bits: int) -> np.ndarray:
    """For each place of texts (hashes of their chunks in a row, begins of the texts) the key of the two chunks before, and in the lowest TAG bits the chunk."""
    n = len(hashes)
    one, two = np.ones(n, np.uint64), np.full(n, 2, np.uint64)
    one[1:], two[2:] = hashes[:-1], hashes[:-2]
    one[begins] = 1
    two[begins] = 2
    second = begins + 1
    two[second[(second < n) & (second < np.r_[begins[1:], n])]] = 2
    context = mix(one * _MUL[0] + two * _MUL[1]) >> np.uint64(64 - bits)
    return (context << np.uint64(TAG)) | (mix(hashes) >> np.uint64(64 - TAG))


def follow_cuts(keys: np.ndarray, buckets: int, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending keys: buckets are equal ranges of the contexts."""
    bucket = ((keys >> np.uint64(TAG + bits - 32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64)).tolist()
    return [(b, x, y) for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]


def flag_code(hit: np.ndarray, often: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """uint8: 0 without a candidate, else its class of contexts met (1, 2, 3 or more), hit or not, and its log odds in quarters."""
    often = np.minimum(np.maximum(often, 0), whole)
    code_ = hit.astype(np.uint8) << np.uint8(5)
    small = (whole > 0) & (whole <= FEW)
    code_ |= few_codes().take(np.where(small, (FEW + 1) * whole + often, 0))
    more = np.flatnonzero(whole > FEW)
    code_[more] |= _flag_odds(often[more], whole[more])
    code_ *= whole > 0
    return code_


def _flag_odds(often: np.ndarray, whole: np.ndarray) -> np.ndarray:
    odds = np.clip(np.rint(4 * np.log((often + 0.4) / (whole - often + 0.4))), -16, 15).astype(np.int64) + 16
    return (odds | np.clip(whole, 0, 3) << 6).astype(np.uint8)


@cache
def few_codes() -> np.ndarray:
    """_flag_odds() of all counts of contexts met FEW times at most."""
    whole, often = np.divmod(np.arange((FEW + 1) ** 2), FEW + 1)
    return np.where(whole > 0, _flag_odds(np.minimum(often, whole), whole), 0).astype(np.uint8)


def flag_codes(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ascending distinct keys of whole contexts, for texts outside training and for those within."""
    if not len(keys):
        return np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    context = keys >> np.uint64(TAG)
    begin = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    size = np.diff(np.r_[begin, len(keys)])
    whole = np.repeat(np.add.reduceat(counts, begin), size)
    most = np.maximum.reduceat(counts, begin)
    top = np.flatnonzero(counts == np.repeat(most, size))
    group = np.repeat(np.arange(len(begin)), size)
    best = top[np.r_[True, group[top][1:] != group[top][:-1]]]  # of equals the least tag
    others = counts.copy()
    others[best] = -1
    second = np.maximum(np.maximum.reduceat(others, begin), 0)
    is_best = np.zeros(len(keys), bool)
    is_best[best] = True
    most, second = np.repeat(most, size), np.repeat(second, size)
    outside = flag_code(is_best, most, whole)
    still = is_best & (most - 1 > second) | is_best & (second == 0)
    within = flag_code(still, np.where(is_best, np.where(still, most - 1, second), most), np.maximum(whole - 1, 0))
    return outside, within


def flag_items() -> np.ndarray:
    """Items of the flags of each code and streak (4 x code + streak), see letter_items()."""
    code_, streak = np.divmod(np.arange(FLAGS), 4)
    sign = np.where(code_ >> 5 & 1, 1, -1)
    rows = np.zeros((FLAGS, INPUTS), np.int8)
    rows[:, 0] = -sign * ((code_ & 31) - 16) * 4
    rows[:, 1] = -sign * 16
    rows[:, -1] = FLAG + 4 * (np.maximum(code_ >> 6, 1) - 1) + streak
    return rows.view(np.int32).ravel()


def letter_items(symbols: np.ndarray, begins: np.ndarray, at: np.ndarray, edge: np.ndarray, place: np.ndarray, starts: Iterable[np.ndarray], odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All flags, then all bits of all chunks, in four bytes each: the log odds by the contexts against the bit that was, and the gate,
    with ZERO added where the bit is 0; and the bits of each chunk.

    at, edge, place: edges_of(); starts: for each context where in odds the walk of each edge begins."""
    steps, begin, _, bits = code()
    steps = steps.astype(np.int32)
    own = symbols[at]
    size = steps[own]
    ends = np.cumsum(size)
    rows = np.empty((int(ends[-1]), INPUTS), np.int8)

    against = -odds

    def fill(k: int, values: np.ndarray, start: np.ndarray, slice_: int = 1 << 16) -> None:
        for x in range(0, len(at), slice_):
            part = size[x : x + slice_]
            to = int(ends[x] - part[0])
            places = ranges(start[x : x + slice_], part)
            rows[to : to + len(places), k] = values.take(places)

    for k, start in enumerate(starts):
        fill(k, against, start)
    fill(CONTEXTS, np.where(bits, 0, ZERO).astype(np.uint8).view(np.int8), begin[own])
    gate = np.repeat((np.minimum(place[at], 3) * 2 + 1).astype(np.int8), size)
    gate[ends - size] -= 1
    rows[:, CONTEXTS] |= gate
    rows = rows.view(np.int32).ravel()
    # edges that follow each other in a chunk as they do in the tree are copied at once
    first = np.flatnonzero(np.r_[True, edge[1:] != edge[:-1] + 1])
    start, end = edge[first], edge[np.r_[first[1:], len(edge)] - 1]
    start = ends[start] - size[start]
    size = ends[end] - start
    ends = np.cumsum(size)
    out = np.empty(FLAGS + int(ends[-1]), np.int32)
    out[:FLAGS] = flag_items()
    for x in range(0, len(start), 1 << 16):
        part = size[x : x + (1 << 16)]
        to = FLAGS + int(ends[x] - part[0])
        places = ranges(start[x : x + (1 << 16)], part)
        rows.take(places, out=out[to : to + len(places)], mode="clip")
    return out, np.add.reduceat(steps[symbols], begins, dtype=np.int64)


def start_weights() -> np.ndarray:
    """(GATES, INPUTS)"""
    return np.array([START[2 if g >= FLAG else g % 2] for g in range(GATES)])


def lane_rows(starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The places `begin` up to `end` of each lane, one lane after another, where items of all lanes lie in a row:
    an item's rows begin at `starts`, are `sizes` many and end at place `ends`."""
    first, last = np.searchsorted(ends, begin, side="right"), np.searchsorted(ends, end - 1, side="right")
    many = last - first + 1
    own = ranges(first, many)
    at, size = starts[own], sizes[own]
    to = np.cumsum(many)
    skip = begin - (ends[first] - sizes[first])
    at[to - many] += skip
    size[to - many] -= skip
    size[to - 1] -= ends[last] - end
    return ranges(at, size)


def mixed_bits(packed: np.ndarray, item_starts: np.ndarray, item_sizes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits of each lane, `sizes` places from `starts` on, at least one; the longest first. Items (where they begin in
    packed, as letter_items() gives it, and their sizes) lie at these places, one after another.

    All lanes advance together, each with weights and bands of its own; those of one gate (and band) lie together.
    Weights are sixteenths, as inputs are taken sixteenfold."""
    n = len(sizes)
    sets = GATES * n
    weights = np.repeat(start_weights() * SCALE, n, axis=0).astype(np.float32).view(np.complex128).ravel()
    right = np.repeat((1 / (1 + np.exp(-(np.arange(BANDS) + 0.5) / 2))).astype(np.float32), sets)
    zero, one, band_rate = np.float32(0), np.float32(1), np.float32(BAND_RATE)
    rate = np.float32(RATE) * np.float32(SCALE * SCALE)
    low, high = np.float32(-LIMIT), np.float32(LIMIT)
    lane = np.arange(n)
    total = np.zeros(n)
    product_, move_, w_, half_, pair_, dot_, size_ = (np.empty(n * k, np.float32) for k in (INPUTS, INPUTS, INPUTS, 2, 2, 1, 1))
    hit_ = np.empty(n, bool)
    item_ends = np.cumsum(item_sizes)
    longest, stride, m = int(sizes[0]), 16, 0
    wide = np.searchsorted(-sizes, -np.arange(longest + 1)).tolist()  # lanes longer than a step
    for at in range(0, longest, stride):
        many = wide[at]
        if at % STEPS == 0:
            size = np.minimum(sizes[:many] - at, STEPS)
            block = packed.take(lane_rows(item_starts, item_sizes, item_ends, starts[:many] + at, starts[:many] + at + size))
            row = np.cumsum(size) - size
            whole = np.searchsorted(-size, -STEPS, side="right")  # lanes that go on beyond these steps
        step = at % STEPS
        rows = np.empty((stride, many), np.int32)
        rows[:, :whole] = block[: whole * STEPS].reshape(whole, STEPS)[:, step : step + stride].T
        rows[:, whole:] = block.take(row[whole:many] + (step + np.arange(stride)[:, None]), mode="clip")
        inputs = rows.view(np.int8)
        kind = (rows.view(np.uint32) >> np.uint32(24)).astype(np.intp)
        set_all = kind & GATE
        set_all *= n
        set_all += lane[:many]
        inputs[:, INPUTS - 1 :: INPUTS] = CONSTANT.take(kind, mode="clip")
        x_all = inputs.astype(np.float32)
        odds, missed = np.ones((stride, many), np.float32), np.zeros((stride, many), np.float32)
        for t in range(min(stride, longest - at)):
            if m != wide[at + t]:
                m = wide[at + t]
                own, product, move, half, pair, dot, size_of = (x[: len(x) // n * m] for x in (w_, product_, move_, half_, pair_, dot_, size_))
                w, sums, hit = own.view(np.complex128), half.view(np.complex64), hit_[:m]
                product_0, product_1 = product.view(np.complex64)[::2], product.view(np.complex64)[1::2]
                half_0, half_1, pair_0, pair_1 = half[::2], half[1::2], pair[::2], pair[1::2]
                twice, move_0, move_1 = pair.view(np.float64), move.view(np.float64)[::2], move.view(np.float64)[1::2]
            x, own_set, p, miss = x_all[t, : m * INPUTS], set_all[t, :m], odds[t, :m], missed[t, :m]
            weights.take(own_set, out=w, mode="clip")
            np.multiply(own, x, out=product)
            np.add(product_0, product_1, out=sums)
            np.add(half_0, half_1, out=dot)
            np.maximum(dot, low, out=dot)
            np.minimum(dot, high, out=dot)
            miss[:] = np.less_equal(dot, zero, out=hit)
            np.abs(dot, out=size_of)
            size_of += size_of
            band = size_of.astype(np.intp)
            band *= sets
            band += own_set
            np.exp(dot, out=dot)
            dot += one
            np.reciprocal(dot, out=p)
            right.take(band, out=dot, mode="clip")
            miss -= dot
            np.multiply(miss, band_rate, out=size_of)
            size_of += dot
            right[band] = size_of
            np.subtract(p, one, out=dot)
            dot *= rate
            pair_0[:] = dot
            pair_1[:] = dot
            move_0[:] = twice
            move_1[:] = twice
            move *= x
            own += move
            weights[own_set] = w
        np.abs(missed, out=missed)
        np.subtract(one, missed, out=missed)
        odds += missed
        odds *= np.float32(0.5)
        eight = np.multiply.reduce(odds.reshape(-1, 8, many), axis=1)  # none is below 2 ** -15
        total[:many] -= np.log2(eight).sum(axis=0, dtype=np.float64)
    return total


def text_bits(chunks: np.ndarray, codes: np.ndarray, begins: np.ndarray, packed: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits of each text. chunks, codes: chunk and flag of all places in a row; begins: of the texts; the others: letter_items()."""
    n = len(chunks)
    size_of = np.r_[np.ones(FLAGS, np.int64), sizes]
    start_of = (np.cumsum(size_of) - size_of).astype(np.int32)
    asked = codes > 0
    hit = asked & (codes >> 5 & 1 > 0)
    streak, before = np.zeros(n, np.int8), np.ones(n, bool)
    place = np.arange(n) - np.repeat(begins, np.diff(np.r_[begins, n]))
    for k in range(1, 4):
        before[k:] &= hit[:-k]
        before &= place >= k
        streak += before
    items = np.column_stack([np.where(asked, 4 * codes.astype(np.int32) + streak, -1), np.where(hit, -1, FLAGS + chunks)]).astype(np.int32).ravel()
    text = np.repeat(np.arange(len(begins), dtype=np.int32), 2 * np.diff(np.r_[begins, n]))
    text, items = text[items >= 0], items[items >= 0]
    size = size_of[items]
    done = np.cumsum(size) - size
    part = (done - done[np.searchsorted(text, np.arange(len(begins), dtype=np.int32))][text]) // SEGMENT
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (part[1:] != part[:-1])])  # items that begin a lane
    lane_size = np.add.reduceat(size, first)
    lane_items = np.diff(np.r_[first, len(items)])
    del done, part, place, before, streak
    order = np.argsort(-lane_size, kind="stable")
    lane_bits = np.empty(len(first))
    batch = np.cumsum(lane_size[order]) // BATCH_BITS + np.arange(len(order)) // LANES
    for lanes in np.split(order, np.flatnonzero(np.diff(batch)) + 1):
        own = items[ranges(first[lanes], lane_items[lanes])]
        ends = np.cumsum(lane_size[lanes])
        lane_bits[lanes] = mixed_bits(packed, start_of[own], size_of[own], ends - lane_size[lanes], lane_size[lanes])
    return np.bincount(text[first], weights=lane_bits, minlength=len(begins))


def words_of(symbols: np.ndarray, begins: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of chunks, A-Z lower-cased; the number of each chunk's words in a row, and how many each chunk has."""
    data = np.where(symbols == 256, 32, symbols).astype(np.uint8)
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(w, len(number)) for w in data.tobytes().lower().split()], np.int64)
    inside = (data != 32) & ((data < 9) | (data > 13))
    inside[1:] &= ~inside[:-1]  # the words' first bytes: a chunk ends in a space
    return list(number), of, np.add.reduceat(inside, begins, dtype=np.int64)


def dealt_words(words: list[bytes], buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of words by bucket, and (bucket, from, to) in that order."""
    bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    cuts = [0, *np.cumsum(np.bincount(bucket, minlength=buckets)).tolist()]
    return np.argsort(bucket, kind="stable"), [(b, x, y) for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]


ASK = "bucket long, block long, payload binary, counts binary, keys binary, times binary, follow binary, met binary"
TOLD = "bucket long, block long, counts binary, distinct long, tokens long, odds binary, codes binary"
OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


def places_of(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct chunks of texts, those that begin alike together: their names and which are a text's last; the chunk
    of each place of all texts in a row, and where each text begins."""
    parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    ends = parts.offsets.to_numpy()[1:].astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    names = coded.dictionary
    order = pc.array_sort_indices(names)
    rank = np.empty(len(names), np.int32)
    rank[order.to_numpy()] = np.arange(len(names), dtype=np.int32)
    places = rank[coded.indices.to_numpy()]
    del parts, coded, rank
    places *= 2
    places[ends - 1] += 1  # the last of a text
    there = np.flatnonzero(np.bincount(places, minlength=2 * len(names)))
    number = np.zeros(2 * len(names), np.int32)
    number[there] = np.arange(len(there), dtype=np.int32)
    return names.take(order.take(pa.array(there >> 1))), (there & 1).astype(bool), number[places], np.r_[0, ends[:-1]]


def chunk_hashes(symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
    """_hashes() of the chunks, each written without its space or with a space for the end."""
    chunks = np.where(symbols == 256, 32, symbols).astype(np.uint8).tobytes()[:-1].split(b" ")
    for k in np.flatnonzero(last).tolist():
        chunks[k] += b" "
    return _hashes(chunks)


def _hashes(chunks: list) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, chunks, repeat(7)), np.uint64, len(chunks))


@keeps_memory
@without_gc
def _ask(table: pa.Table, buckets: int, bits: int) -> pa.Table:
    ids, texts = block_rows(table)
    held = np.array([is_held_out(i) for i in ids], bool)
    names, last, places, text_begins = places_of(texts)
    del texts
    learned = np.repeat(~held, np.diff(np.r_[text_begins, len(places)]))
    seen = np.bincount(places[learned], minlength=len(last))
    symbols, begins = symbols_of(names, last)
    del names
    words, of, many = words_of(symbols, begins)
    counts = np.bincount(of, weights=np.repeat(seen, many), minlength=len(words) + 1).astype(np.int64)
    counts[-1] = int((~held).sum())
    words.append(END_WORD)
    order, cuts = dealt_words(words, buckets)
    counts = counts[order]
    words = [words[k] for k in order.tolist()]
    asked = {b: (join_words(words[x:y]), pack_counts(counts[x:y])) for b, x, y in cuts}
    del words, of, many
    follow = follow_keys(chunk_hashes(symbols, last)[places], text_begins, bits)
    at, edge, place = edges_of(symbols, begins)
    often = np.bincount(edge, weights=np.repeat(seen, np.diff(np.r_[begins, len(symbols)])))
    del edge
    found = []
    for keys, number in pairs_of(symbols, at, place, bits):
        found.append((keys, np.bincount(number, weights=often).astype(np.int64)))
        del keys, number
    keys, times = (np.concatenate(x) for x in zip(*found, strict=True))  # ascending: the context's number is on top
    del found, symbols, often, at, place
    order, cuts = dealt(keys, buckets)
    keys, times = keys[order], times[order]
    pairs = {b: (pack_keys(keys[x:y]), pack_counts(times[x:y])) for b, x, y in cuts}
    follow, number = numbered(follow)
    met = np.bincount(number, weights=learned, minlength=len(follow)).astype(np.int64)
    next_ = {b: (pack_keys(follow[x:y]), pack_counts(met[x:y])) for b, x, y in follow_cuts(follow, buckets, bits)}
    none = (pack_keys(keys[:0]), pack_counts(times[:0]))
    block = table.column("block")[0].as_py()
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *[(c, pa.binary()) for c in ("payload", "counts", "keys", "times", "follow", "met")]])
    out: dict[str, list] = {f.name: [] for f in schema}
    for bucket in sorted(asked.keys() | pairs.keys() | next_.keys()):
        row = (bucket, block, *asked.get(bucket, (join_words([]), none[1])), *pairs.get(bucket, none), *next_.get(bucket, none))
        for name, value in zip(out, row, strict=True):
            out[name].append(value)
    return pa.Table.from_batches([batch_of(out, schema)])


@keeps_memory
@without_gc
def _tell(table: pa.Table) -> pa.Table:
    place: dict[bytes, int] = {}
    asked = []
    total = np.zeros(0, np.int64)
    for payload, counts in zip(table.column("payload"), table.column("counts"), strict=True):
        at = np.array([place.setdefault(w, len(place)) for w in split_words(payload.as_py())], np.int64)
        if len(place) > len(total):
            total = np.r_[total, np.zeros(len(place) - len(total), np.int64)]
        total[at] += unpack_counts(counts.as_py())
        asked.append(at)
    n = table.num_rows
    sums = [int((total > 0).sum()), int(total.sum())]
    told = [pack_bytes(total[at].tobytes()) for at in asked]
    del place, asked
    odds = _tell_odds(_column(table, "keys", unpack_keys), _column(table, "times", unpack_counts))
    codes = _tell_codes(_column(table, "follow", unpack_keys), _column(table, "met", unpack_counts))
    return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "counts": pa.array(told, pa.binary()), "distinct": pa.array([sums[0]] + [0] * (n - 1), pa.int64()), "tokens": pa.array([sums[1]] + [0] * (n - 1), pa.int64()), "odds": pa.array(odds, pa.binary()), "codes": pa.array(codes, pa.binary())})


def _column(table: pa.Table, name: str, unpack) -> list[np.ndarray]:
    return [unpack(x.as_py()) for x in table.column(name)]


def _added(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of all blocks, their counts, and the number of each block's keys among them, in a row."""
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(inverse, weights=np.concatenate(times), minlength=len(distinct)), inverse


def _tell_odds(keys: list[np.ndarray], times: list[np.ndarray]) -> list[bytes]:
    """For each block the log odds of the walks of its keys, by the counts of all blocks."""
    distinct, counts, inverse = _added(keys, times)
    size, odds = walk_odds(distinct, counts)
    start = np.cumsum(size) - size
    out, at = [], 0
    for own in keys:
        rows = inverse[at : at + len(own)]
        at += len(own)
        out.append(pack_bytes(odds[ranges(start[rows], size[rows])].tobytes()))
    return out


def _tell_codes(keys: list[np.ndarray], met: list[np.ndarray]) -> list[bytes]:
    """For each block the flag codes of its keys: those for texts outside training, then those for texts within."""
    distinct, counts, inverse = _added(keys, met)
    codes = np.stack(flag_codes(distinct, counts.astype(np.int64)))
    ends = np.cumsum([len(k) for k in keys]).tolist()
    return [pack_bytes(np.ascontiguousarray(codes[:, inverse[a:b]]).tobytes()) for a, b in zip([0, *ends], ends, strict=False)]


def _letters(symbols: np.ndarray, begins: np.ndarray, told: dict[int, bytes], buckets: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """letter_items() of a block's distinct chunks, by what the buckets told."""
    at, edge, place = edges_of(symbols, begins)
    found = list(pairs_of(symbols, at, place, bits))
    keys = np.concatenate([x for x, _ in found])
    found = [(len(x), number) for x, number in found]
    order, cuts = dealt(keys, buckets)
    odds = np.concatenate([np.frombuffer(unpack_bytes(told[b]), np.int8) for b, _, _ in cuts])
    size = code()[0][code_order()[1][(keys[order] & np.uint64((1 << SYMBOL) - 1)).astype(np.int64)]]
    start = np.empty(len(keys), np.int32)
    start[order] = np.cumsum(size) - size
    del keys, order, size
    base = np.cumsum([0, *[n for n, _ in found]])
    return letter_items(symbols, begins, at, edge, place, (start[x + number] for x, (_, number) in zip(base, found, strict=False)), odds)


def _codes(hashes: np.ndarray, places: np.ndarray, begins: np.ndarray, held: np.ndarray, told: dict[int, bytes], buckets: int, bits: int) -> np.ndarray:
    """The flag code of each place."""
    keys, number = numbered(follow_keys(hashes[places], begins, bits))
    codes = np.concatenate([np.frombuffer(unpack_bytes(told[b]), np.uint8).reshape(2, -1) for b, _, _ in follow_cuts(keys, buckets, bits)], axis=1)
    within = np.repeat(~held, np.diff(np.r_[begins, len(places)])).astype(np.int64)
    return codes[within, number]


@keeps_memory
@without_gc
def _score(docs: pa.Table, told: pa.Table, buckets: int, bits: int, distinct: int, tokens: int) -> pa.Table:
    ids, texts = block_rows(docs)
    held = np.array([is_held_out(i) for i in ids], bool)
    names, last, places, begins = places_of(texts)
    size = np.fromiter((len(t.encode()) + 1 for t in texts), np.int64, len(texts))
    del texts
    symbols, chunk_begins = symbols_of(names, last)
    del names
    by_bucket = {name: dict(zip(told.column("bucket").to_pylist(), told.column(name).to_pylist(), strict=True)) for name in ("counts", "odds", "codes")}
    words, of, many = words_of(symbols, chunk_begins)
    order, cuts = dealt_words([*words, END_WORD], buckets)
    count = np.empty(len(order), np.int64)
    count[order] = np.concatenate([np.frombuffer(unpack_bytes(by_bucket["counts"][b]), np.int64) for b, _, _ in cuts])
    # what each distinct chunk adds to its text's base: tokens, known tokens, sum of log10(c + 1)
    own = np.repeat(np.arange(len(many)), many)
    sums = (many, np.bincount(own, weights=count[of] > 0, minlength=len(many)), np.bincount(own, weights=np.log10(count + 1.0)[of], minlength=len(many)))
    n, known, logs = (np.add.reduceat(x[places], begins) + end for x, end in zip(sums, (1, count[-1] > 0, log10(count[-1] + 1)), strict=True))
    base = logs - n * log10(tokens + distinct + 1)
    del words, of, order, count, own, sums
    codes = _codes(chunk_hashes(symbols, last), places, begins, held, by_bucket["codes"], buckets, bits)
    total = text_bits(places, codes, begins, *_letters(symbols, chunk_begins, by_bucket["odds"], buckets, bits))
    out = {"doc_id": ids, "held_out": held, "n_tokens": n.astype(np.int64), "n_known": known.astype(np.int64), "train_tokens": [tokens] * len(ids), "base_score": base, "score": -total * log10(2), "bits_per_byte": total / size}
    return pa.Table.from_batches([batch_of(out, OUT)])


def score_documents(docs: DataFrame, block_bytes: int = 7 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte (the end counts as a byte) of every row."""
    spark = docs.sparkSession
    prepare(spark)
    blocks = Blocks(docs, block_bytes, ordered=False)
    buckets, bits = blocks.n, context_bits(blocks.size)
    told = blocks.frame.groupBy("block").applyInArrow(lambda t: freed(_ask(t, buckets, bits)), ASK).groupBy("bucket").applyInArrow(lambda t: freed(_tell(t)), TOLD)
    told = materialize(told, "word-counts")
    distinct, tokens = told.agg(F.sum("distinct"), F.sum("tokens")).first()
    both = blocks.frame.groupBy("block").cogroup(told.groupBy("block"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return both.applyInArrow(lambda left, right: freed(_score(left, right, buckets, bits, distinct or 0, tokens or 0)), schema)


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
