"""The parts that the ranker trains on: whole groups in NumPy arrays, one row of a table each.

A part answers sums (gradients of histogram cells, metrics), which add up to those of all rows; a model of one part is fitted inside one task,
one of many by a Spark job for every level of a tree. Gradients are whole multiples of 2^-28, so sums do not depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import RankerConfig
from lodestone.operators import sampling
from lodestone.sources.stores import discard, written

ROWS = 1 << 16  # of a part, about
BINS = 32
KNOWN = 256  # values that a part tells of a feature
UNIT = float(1 << 28)
PAIRS = 1 << 20  # held at once
DIGITS = 9  # of a score in a metric, as in evaluate


class Part:
    """Rows of whole groups, sorted by group and pid; groups are numbered from 0, copies of rare rows are in none (-1)."""

    def __init__(self, x: np.ndarray, relevance: np.ndarray, val: np.ndarray, group: np.ndarray, keys: list[bytes]):
        self.x, self.relevance, self.val, self.group, self.keys = x, relevance, val, group, keys
        self.score, self.g, self.h = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
        self.bag = np.zeros(0, np.int64)
        self.bins: np.ndarray | None = None
        self.batches = self._batches()

    def _batches(self) -> list[np.ndarray]:
        """Rows of the training groups that have pairs, groups of like size side by side; -1 fills a row up."""
        inside = np.flatnonzero((self.group >= 0) & ~self.val)
        if not len(inside):
            return []
        group = self.group[inside]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(group)])
        grades = self.relevance[inside]
        mixed = np.minimum.reduceat(grades, starts) != np.maximum.reduceat(grades, starts)
        made, rest = [], [k for k in np.argsort(sizes, kind="stable")[::-1] if mixed[k]]
        while rest:
            m = int(sizes[rest[0]])
            take, rest = rest[: max(1, PAIRS // (m * m))], rest[max(1, PAIRS // (m * m)) :]
            at = np.full((len(take), m), -1)
            for i, k in enumerate(take):
                at[i, : sizes[k]] = inside[starts[k] : starts[k] + sizes[k]]
            made.append(at)
        return made

    def values(self) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """Of each feature, values of the training rows and how many rows each stands for; whether these are all values."""
        told = []
        for column in self.x[~self.val].T:
            value, n = np.unique(column[~np.isnan(column)], return_counts=True)
            whole = len(value) <= KNOWN
            if not whole:
                at = np.minimum((np.cumsum(n) - 1) * KNOWN // n.sum(), KNOWN - 1)  # the share of rows that a value ends
                last = np.flatnonzero(np.r_[at[1:] != at[:-1], True])
                value, n = value[last], np.diff(np.r_[0, np.cumsum(n)[last]])
            told.append((value.astype(np.float64), n, whole))
        return told

    def start(self, edges: list[np.ndarray], tree, turn: int | None, config: RankerConfig) -> None:
        """Scores with the last tree, then gradients and the bag of the next round (turn None: all rows)."""
        if self.bins is None:
            self.bins = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, self.x.T, strict=True)]).astype(np.uint8)
        if tree is not None:
            self.score += tree.scores(self.x)
        self._gradients()
        train = np.flatnonzero(~self.val)
        self.bag = train if turn is None else train[[self._drawn(turn, i, config) for i in train]]

    def _drawn(self, turn: int, i: int, config: RankerConfig) -> bool:
        """Whether LambdaRanker._bag keeps the row."""
        share = lambda seed: int(hashlib.md5(b"%d:%s" % (seed, self.keys[i])).hexdigest()[:8], 16) / float(1 << 32)
        return share(turn) < config.bagging_fraction and (self.relevance[i] > 0 or share(turn + 7919) < config.neg_bagging_fraction)

    def _gradients(self) -> None:
        """lambda and hessian of every row: NDCG-weighted pairwise logistic over the pairs of a group with different labels."""
        self.g, self.h = np.zeros(len(self.x)), np.zeros(len(self.x))
        for at in self.batches:
            here, m = at >= 0, at.shape[1]
            score = np.where(here, self.score[at], -np.inf)
            grade = np.where(here, self.relevance[at], 0.0)
            place = np.argsort(np.argsort(-score, axis=1, kind="stable"), axis=1)  # ties by pid
            discount = 1 / np.log2(place + 2)
            best = (-np.sort(-grade, axis=1) / np.log2(np.arange(m) + 2)).sum(axis=1)
            best = np.where(best > 0, best, np.inf)
            score = np.where(here, score, 0.0)
            g, h = np.zeros(at.shape), np.zeros(at.shape)
            step = max(1, PAIRS // at.size)
            for a in range(0, m, step):
                own = np.s_[:, a : a + step, None]
                more = np.where(here[:, None, :] & here[own], grade[own] - grade[:, None, :], 0.0).clip(0)
                delta = more * np.abs(discount[own] - discount[:, None, :]) / best[:, None, None]
                with np.errstate(over="ignore"):
                    rho = 1 / (1 + np.exp(score[own] - score[:, None, :]))
                up = rho * delta
                g[:, a : a + step] += up.sum(axis=2)
                g -= up.sum(axis=1)
                up *= 1 - rho
                h[:, a : a + step] += up.sum(axis=2)
                h += up.sum(axis=1)
            self.g[at[here]] = np.rint(g[here] * UNIT) / UNIT
            self.h[at[here]] = np.rint(h[here] * UNIT) / UNIT

    def histogram(self, nodes: list[tuple[int, int, int, int]], columns: list[int], ask: list[int]) -> np.ndarray:
        """Count, lambda and hessian of the bag's rows by node (of ask), feature (of columns) and bin; nodes: feature, bin, low, high."""
        feature, bin_, low, high = (np.array(a) for a in zip(*nodes, strict=True))
        rows = self.bag
        at = np.zeros(len(rows), np.int64)
        while (feature[at] >= 0).any():
            at = np.where(self.bins[rows, feature[at]] <= bin_[at], low[at], high[at])
        slot = np.full(len(nodes), -1)
        slot[ask] = np.arange(len(ask))
        kept = slot[at] >= 0
        rows, slot = rows[kept], slot[at][kept]
        made = np.zeros((len(ask), len(columns), BINS, 3))
        for k, c in enumerate(columns):
            cell = slot * BINS + self.bins[rows, c]
            for j, weights in enumerate((None, self.g[rows], self.h[rows])):
                made[:, k, :, j] = np.bincount(cell, weights, len(ask) * BINS).reshape(len(ask), BINS)
        return made

    def metric(self, tree, k: int) -> np.ndarray:
        """[train, val] x [sum of NDCG at k, groups]: evaluate.ndcg of the scores with the tree; copies are no group."""
        score, made = np.round(self.score + tree.scores(self.x), DIGITS), np.zeros((2, 2))
        for side, rows in enumerate((np.flatnonzero(~self.val & (self.group >= 0)), np.flatnonzero(self.val & (self.group >= 0)))):
            if not len(rows):
                continue
            group, grade = self.group[rows], self.relevance[rows]
            new = np.r_[True, group[1:] != group[:-1]]
            number, place = np.cumsum(new) - 1, np.arange(len(rows)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            discount = np.where(place < k, 1 / np.log2(place + 2), 0.0)
            order = np.lexsort((-score[rows], group))
            tie = np.cumsum(new | np.r_[True, np.diff(score[rows][order]) != 0]) - 1
            mean = np.bincount(tie, grade[order]) / np.bincount(tie)
            ideal = np.bincount(number, grade[np.lexsort((-grade, group))] * discount)
            got = np.bincount(number, mean[tie] * discount)
            made[side] = (got[ideal > 0] / ideal[ideal > 0]).sum(), (ideal > 0).sum()
        return made


def parts(train: DataFrame, val: DataFrame, names: list[str]) -> DataFrame:
    """(part, data): pickled parts of rows (qid, pid, relevance, features)."""
    sides = [df.select("qid", "pid", F.col("relevance").cast("double").alias("relevance"), *names, F.lit(v).alias("_val")) for df, v in ((train, False), (val, True))]
    rows = sides[0].unionByName(sides[1])
    qid = F.col("qid").cast("string")
    rows = rows.withColumn("_key", F.concat_ws(":", qid, F.col("pid").cast("string"))).withColumn("_copy", F.coalesce(qid == sampling.EXTRA, F.lit(False)))
    n = max(1, -(-rows.count() // ROWS))
    rows = rows.withColumn("part", F.pmod(F.when(F.col("_copy"), F.xxhash64("_key")).otherwise(F.xxhash64(qid)), F.lit(n)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("_val", "qid", "pid")], null_placement="at_start"))
        column = lambda c: table.column(c).combine_chunks()
        x = np.column_stack([column(c).to_numpy(zero_copy_only=False) for c in names]).astype(np.float32)
        val, copy = (column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("_val", "_copy"))
        code = pc.dictionary_encode(column("qid"), null_encoding="encode").indices.to_numpy()
        group = np.where(copy, -1, np.cumsum(np.r_[0, (np.diff(code) != 0) | np.diff(val)]))
        made = Part(x, column("relevance").to_numpy(zero_copy_only=False), val, group, [k.encode() for k in column("_key").to_pylist()])
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "data": pa.array([pickle.dumps(made)], pa.binary())})

    return written(rows.groupBy("part").applyInArrow(pack, "part int, data binary"), "parts")


def each(table: DataFrame, f: Callable[[Part], object], schema: str = "part int, data binary") -> DataFrame:
    """(part, data) of f's pickled results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(f(pickle.loads(data)))], pa.binary())], names=["part", "data"])

    return table.mapInArrow(run, schema)


class Here:
    """One part in this process."""

    def __init__(self, part: Part):
        self.part = part

    def change(self, method: str, *args) -> None:
        getattr(self.part, method)(*args)

    def total(self, method: str, *args):
        return getattr(self.part, method)(*args)

    def values(self) -> list:
        return [self.part.values()]


class Spread:
    """Parts in a table: a change writes it anew, and a total is a job whose tasks add up their parts' answers."""

    def __init__(self, table: DataFrame):
        self.table = table

    def change(self, method: str, *args) -> None:
        def changed(part: Part) -> Part:
            getattr(part, method)(*args)
            return part

        last, self.table = self.table, written(each(self.table, changed), "parts")
        discard(last)

    def total(self, method: str, *args):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = 0
            for batch in batches:
                for data in batch.column(1).to_pylist():
                    whole = whole + getattr(pickle.loads(data), method)(*args)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(whole)], pa.binary())], names=["data"])

        return reduce(lambda a, b: a + b, [pickle.loads(r["data"]) for r in self.table.mapInArrow(run, "data binary").collect()])  # one array a task

    def values(self) -> list:
        told = each(self.table, lambda part: part.values()).orderBy("part")
        return [pickle.loads(r["data"]) for r in told.collect()]  # at most KNOWN values of a feature for each part


def edges(told: list[list[tuple[np.ndarray, np.ndarray, bool]]]) -> list[np.ndarray]:
    """Of each feature, at most BINS - 1 values up to which a cell reaches: all values of few, else even shares of the rows."""
    made = []
    for feature in zip(*told, strict=True):
        value, at = np.unique(np.concatenate([v for v, _, _ in feature]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n for _, n, _ in feature]), len(value))
        if len(value) > BINS:
            share = np.minimum(np.floor((np.cumsum(n) - 1) * BINS / n.sum()), BINS - 1)
            value = value[np.r_[share[1:] != share[:-1], True]]
        made.append(value[:-1])
    return made


def grow(data: Here | Spread, cuts: list[np.ndarray], columns: list[int], config: RankerConfig, n_features: int) -> tuple[dict, list[float]] | None:
    """A tree's table and the features' gains: level by level, the cell boundary that takes most off the variance of lambdas. None: no row in the bag."""
    nodes, sums, gains = [(-1, 0, 0, 0)], [(0.0, 0.0)], [0.0] * n_features
    open_ = [0]
    for level in range(config.max_depth):
        cells = np.cumsum(data.total("histogram", nodes, columns, open_), axis=2)
        whole = cells[:, 0, -1]
        if level == 0:
            if not whole[0, 0]:
                return None
            sums[0] = tuple(whole[0, 1:])
        n, g = cells[..., 0], cells[..., 1]
        rest_n, rest_g = whole[:, None, None, 0] - n, whole[:, None, None, 1] - g
        gain = g**2 / np.maximum(n, 1) + rest_g**2 / np.maximum(rest_n, 1) - (whole[:, 1] ** 2 / np.maximum(whole[:, 0], 1))[:, None, None]
        gain = np.where((n >= config.min_rows_in_leaf) & (rest_n >= config.min_rows_in_leaf), gain, 0.0)
        children = []
        for i, node in enumerate(open_):
            k, b = np.unravel_index(np.argmax(gain[i]), gain[i].shape)
            if gain[i, k, b] <= 1e-12:
                continue
            gains[columns[k]] += float(gain[i, k, b])
            nodes[node] = (columns[k], int(b), len(nodes), len(nodes) + 1)
            for own in (cells[i, k, b], whole[i] - cells[i, k, b]):
                children.append(len(nodes))
                nodes.append((-1, 0, len(nodes), len(nodes)))
                sums.append((float(own[1]), float(own[2])))
        open_ = children
        if not open_:
            break
    table = {
        "feature": [int(f) for f, _, _, _ in nodes],
        "threshold": [float(cuts[f][b]) if f >= 0 else 0.0 for f, b, _, _ in nodes],
        "low": [a for _, _, a, _ in nodes],
        "high": [a for _, _, _, a in nodes],
        "value": [0.0 if f >= 0 else config.learning_rate * float(g) / (float(h) + config.l2) for (f, _, _, _), (g, h) in zip(nodes, sums, strict=True)],
    }
    whole = sum(gains) or 1.0
    return table, [g / whole for g in gains]
