"""Packing: non-negative least squares over length combinations, and a greedy best fit of the rest.

A document's ids are cut into full windows of WINDOW and one remainder. Only the histogram of the remainders
(at most WINDOW - 1 counts) reaches the driver. There, combinations of two or three lengths that fill a
window exactly are enumerated, repeat counts that come nearest to the histogram are solved for by
non-negative least squares and rounded, the largest first, as far as pieces last. The rest goes, the longest pieces first,
each into the window with the least room that takes it, for all pieces of a length at a time. What fits nowhere, and only
that, is cut: end to end into the room that is left, and at the end at powers of two, so no sequence needs padding.

Pieces find their place by their rank among the pieces of their length: rank, window and offset follow from
the plan by arithmetic, so no group of equal lengths is ever gathered. Ranks are counted as the texts are encoded, by
input part, and raised by the counts of the parts before.

Defined results: a null text is empty and has the end id alone; repeated rows and ties are packed each; an
empty table gives no piece. Other columns are not read, null ids stay null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import doc_columns, documents, freed, materialize, prepare
from lodestone.llm.tokens import encoder

FILE = "word_bpe_49k.json"
END = 1
WINDOW = 2048
#: Three-part combinations take one of so many most frequent lengths.
FREQUENT = 32
#: Share of the tokenizer's tables: the JVM beside the workers sorts and joins.
ROOM = 0.4


def combinations(counts: np.ndarray, window: int = WINDOW, frequent: int = FREQUENT) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to the window, of lengths that occur; counts: by length."""
    occur = np.flatnonzero(counts)
    occur = occur[occur > 0]
    have = np.zeros(window + 1, bool)
    have[occur] = True
    low = occur[occur <= window // 2]
    two = low[have[window - low]]
    rows = [np.column_stack([two, window - two, np.zeros_like(two)])]
    for a in sorted(occur, key=lambda x: (-counts[x], x))[:frequent]:
        rest = window - a
        b = occur[(occur <= rest // 2) & (occur < rest)]
        b = b[have[rest - b]]
        rows.append(np.column_stack([np.full_like(b, a), b, rest - b]))
    return np.unique(np.sort(np.concatenate(rows), axis=1), axis=0)


def solve_nnls(rows: np.ndarray, counts: np.ndarray, most: int = 3000, close: float = 1e-3) -> tuple[np.ndarray, int, float]:
    """x >= 0 with A x nearest to counts, where column k of A counts the lengths of rows[k]: projected gradient with momentum.

    Ends when the optimality conditions hold to within `close` of the greatest count; returns x, rounds and what is left of them."""
    target = counts.astype(float)
    target[0] = 0
    used = rows > 0
    column = np.sqrt((used.sum(axis=1)).max() * max(1, np.bincount(rows[used], minlength=len(counts)).max()))
    step = 1.0 / max(1.0, column**2)
    x = y = np.zeros(len(rows))
    t = 1.0
    off = np.inf

    def gradient(z: np.ndarray) -> np.ndarray:
        made = np.bincount(rows.ravel(), weights=np.repeat(z, rows.shape[1]), minlength=len(counts))
        made[0] = 0
        grad = (made - target)[rows]
        grad[~used] = 0
        return grad.sum(axis=1)

    for k in range(most):
        new = np.maximum(0.0, y - step * gradient(y))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
        if k % 50 == 49:
            grad = gradient(x)
            off = float(np.abs(np.minimum(x, grad)).max() / max(1.0, target.max()))
            if off <= close:
                return x, k + 1, off
    return x, most, off


@dataclass(frozen=True)
class Plan:
    """Where pieces go, by their length and rank.

    slots: rows (length, lo, hi, times, first, offset) by length and lo: pieces of the ranks lo <= rank < hi, `times` of them
    in each window from `first` on, from `offset`. gaps: rows (first, windows, room): windows that have room left at their end,
    which pieces of ranks from taken[length] on fill, the longest lengths first; tail: cuts of the last window. solved, fitted: ids
    placed by the least squares and by best fit; cut: pieces that fit nowhere."""

    slots: np.ndarray
    taken: np.ndarray
    gaps: np.ndarray
    base: np.ndarray
    tail: list[int]
    windows: int
    solved: int
    fitted: int
    cut: int
    rounds: int
    off: float


def plan(counts: np.ndarray, window: int = WINDOW) -> Plan:
    left = counts.astype(np.int64).copy()
    left[0] = 0
    slots: list[tuple[int, int, int, int, int, int]] = []
    windows = rounds = 0
    off = 0.0
    taken = np.zeros_like(left)
    lengths = np.arange(len(left))
    rows = combinations(left, window)
    if len(rows):
        x, rounds, off = solve_nnls(rows, left)
        for k in np.lexsort((np.arange(len(x)), -x)):
            want = int(x[k] + 0.5)
            if not want:
                break
            parts, times = np.unique(rows[k][rows[k] > 0], return_counts=True)
            n = int(min([want, *(left[parts] // times)]))
            if n <= 0:
                continue
            offset = 0
            for length, m in zip(parts.tolist(), times.tolist(), strict=True):
                slots.append((length, int(taken[length]), int(taken[length]) + n * m, m, windows, offset))
                taken[length] += n * m
                left[length] -= n * m
                offset += length * m
            windows += n
    solved = int((taken * lengths).sum())
    # best fit: windows by the room they have, in stretches of equal ones
    total = int((left * lengths).sum())
    rooms: dict[int, list[tuple[int, int]]] = {window: [(windows, total // window)]} if total >= window else {}
    have = np.zeros(window + 1, bool)
    have[list(rooms)] = True
    for length in np.flatnonzero(left)[::-1].tolist():
        while left[length]:
            room = length + int(np.argmax(have[length:]))
            if not have[room]:
                break
            first, n = rooms[room].pop()
            m = min(n, int(left[length]))
            slots.append((length, int(taken[length]), int(taken[length]) + m, 1, first, window - room))
            taken[length] += m
            left[length] -= m
            if m < n:
                rooms[room].append((first + m, n - m))
            have[room] = bool(rooms[room])
            if room > length:
                rooms.setdefault(room - length, []).append((first, m))
                have[room - length] = True
    gaps = [(first, n, room) for room in sorted(rooms, reverse=True) for first, n in sorted(rooms[room])]
    base = np.concatenate([np.cumsum((left * lengths)[::-1])[::-1][1:], [0]])  # the longest first
    tail = tail_cuts(total % window)
    return Plan(
        slots=np.array(sorted(slots), np.int64).reshape(-1, 6),
        taken=taken,
        gaps=np.array(gaps, np.int64).reshape(-1, 3),
        base=base,
        tail=tail,
        windows=windows + total // window,
        solved=solved,
        fitted=int((taken * lengths).sum()) - solved,
        cut=int(left.sum()),
        rounds=rounds,
        off=off,
    )


def tail_cuts(total: int) -> list[int]:
    """Where the last, unfilled window of `total` ids is cut into powers of two, its begin and end included."""
    cuts = [0]
    for bit in range(total.bit_length() - 1, -1, -1):
        if total >> bit & 1:
            cuts.append(cuts[-1] + (1 << bit))
    return cuts


def encode(docs: DataFrame, file: str = FILE, end: int = END, window: int = WINDOW) -> DataFrame:
    """Of every row doc_id, n and ids (uint16 bytes); its part of the input, the full windows before it there, the length of
    its remainder, and how many such remainders come before it there."""
    prepare(docs.sparkSession)
    names = ["doc_id", "n", "ids", "part", "full_before", "r", "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([end], np.uint16).tobytes()
        part = TaskContext.get().partitionId()
        seen = np.zeros(window, np.int64)
        windows = 0
        for batch in batches:
            coded = [x + tail for x in encoder(file, ROOM).encode([t or "" for t in batch.column("text").to_pylist()])]
            n = np.array([len(x) // 2 for x in coded], np.int64)
            full, r = np.divmod(n, window)
            order = np.argsort(r, kind="stable")
            first = np.searchsorted(r[order], r[order])
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - first
            rank += seen[r]
            seen += np.bincount(r, minlength=window)
            before = windows + np.cumsum(full) - full
            windows += int(full.sum())
            arrays = [pa.array(n), pa.array(coded, pa.binary()), pa.array(np.full(len(n), part, np.int64)), pa.array(before), pa.array(r), pa.array(rank)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=names)
            freed()

    return doc_columns(docs).mapInArrow(run, "doc_id long, n long, ids binary, part long, full_before long, r long, rank long")


def cut_pieces(made: Plan, window: int, length: int, at: int) -> list[tuple[int, int, int, int]]:
    """(start in the piece, ids, window, offset) of a piece that lies from `at` on in the room of the gaps and the tail."""
    out = []
    ends = np.cumsum(made.gaps[:, 1] * made.gaps[:, 2])
    room = int(ends[-1]) if len(ends) else 0
    done = 0
    while done < length:
        here = at + done
        if here < room:
            k = int(np.searchsorted(ends, here, side="right"))
            first, n, size = made.gaps[k].tolist()
            number, inside = divmod(here - (int(ends[k]) - n * size), size)
            take, place, offset = size - inside, first + number, window - size + inside
        else:
            k = int(np.searchsorted(made.tail, here - room, side="right"))
            take, place, offset = made.tail[k] - (here - room), made.windows + k - 1, here - room - made.tail[k - 1]
        take = min(take, length - done)
        out.append((done, take, place, offset))
        done += take
    return out


def place(made: Plan, window: int, n: np.ndarray, r: np.ndarray, rank: np.ndarray, full0: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """(start, ids, window, offset) of all pieces of documents of n ids, whose remainder r has the rank and whose full windows come after full0 others."""
    whole = made.windows + len(made.tail) - 1
    key = made.slots[:, 0] << 44 | made.slots[:, 1]
    slot = np.searchsorted(key, r << 44 | rank, side="right") - 1
    out = []
    for k, (size, rest, own, before) in enumerate(zip(n.tolist(), r.tolist(), rank.tolist(), full0.tolist(), strict=True)):
        pieces = [(i * window, window, whole + before + i, 0) for i in range(size // window)]
        if rest and own < made.taken[rest]:
            _, lo, _, times, first, offset = made.slots[slot[k]].tolist()
            number, inside = divmod(own - lo, times)
            pieces.append((size - rest, rest, first + number, offset + inside * rest))
        elif rest:
            pieces += [(size - rest + a, b, c, d) for a, b, c, d in cut_pieces(made, window, rest, int(made.base[rest]) + (own - int(made.taken[rest])) * rest)]
        out.append(pieces)
    return out


def histogram(by_part: DataFrame, window: int = WINDOW) -> np.ndarray:
    counts = np.zeros(window + 1, np.int64)
    for row in by_part.groupBy("r").agg(F.sum("c").alias("c")).collect():  # at most `window` rows
        counts[row["r"]] = row["c"]
    counts[0] = 0
    return counts


def pack(docs: DataFrame, window: int = WINDOW, file: str = FILE, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    coded = materialize(encode(docs, file, end, window), "encoded")
    by_part = materialize(coded.groupBy("part", "r").agg(F.count("*").alias("c"), F.sum(F.expr(f"n div {window}")).alias("f")), "piece-counts")
    made = plan(histogram(by_part, window), window)
    rank0 = F.sum("c").over(Window.partitionBy("r").orderBy("part")) - F.col("c")
    full0 = by_part.groupBy("part").agg(F.sum("f").alias("f")).select("part", (F.sum("f").over(Window.orderBy("part")) - F.col("f")).alias("full0"))  # a row for each part of the input
    before = by_part.select("part", "r", rank0.alias("rank0")).join(full0, "part")
    joined = coded.join(before, ["part", "r"]).select("doc_id", "n", "ids", "r", (F.col("rank") + F.col("rank0")).alias("rank"), (F.col("full_before") + F.col("full0")).alias("full0"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_numpy() for c in ("n", "r", "rank", "full0")]
            for doc_id, n, ids, own in zip(batch.column("doc_id").to_pylist(), columns[0].tolist(), batch.column("ids"), place(made, window, *columns), strict=True):
                data = np.frombuffer(ids.as_buffer(), "<u2").astype("<u4").tobytes()
                out += [(doc_id, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n, number, offset) for start, length, number, offset in own]
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return joined.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
