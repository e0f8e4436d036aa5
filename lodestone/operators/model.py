"""Learning to rank: pairwise lambda gradients with linear gain, bagging, and early stopping.

Each round ranks the rows of every group, sums the lambda gradients of all pairs with different labels in
the group, fits a regression tree to them on a share of the rows and features, and gives the tree's leaves Newton steps. Rows are
dealt in parts of whole groups (boosting.py): one part is fitted inside one task, many write their scores and gradients out every round; metrics come every MEASURE rounds.
A fitted model is a list of plain tables, one for each tree: it is scored in batches by NumPy, with or without Spark.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import RankerConfig
from lodestone.functions import fixed
from lodestone.operators import boosting, sampling
from lodestone.sources.stores import inside

MEASURE = 5


@dataclass
class Tree:
    """Nodes in arrays: the feature asked (-1: a leaf), its threshold, the nodes for values up to it and over it, and a leaf's value."""

    feature: list[int]
    threshold: list[float]
    low: list[int]
    high: list[int]
    value: list[float]

    @classmethod
    def of(cls, fitted: DecisionTreeRegressionModel, columns: list[int], leaves: dict[int, float]) -> Tree:
        """A fitted tree over some of the features, with the values of its leaves, which are numbered from left to right."""
        made = cls([], [], [], [], [])
        leaf = 0

        def walk(node) -> int:
            nonlocal leaf
            at = len(made.feature)
            inner = node.numDescendants() > 0
            split = node.split() if inner else None
            made.feature.append(columns[split.featureIndex()] if inner else -1)
            made.threshold.append(float(split.threshold()) if inner else 0.0)
            made.value.append(0.0 if inner else leaves.get(leaf, 0.0))
            made.low.append(at)
            made.high.append(at)
            if inner:
                made.low[at] = walk(node.leftChild())
                made.high[at] = walk(node.rightChild())
            else:
                leaf += 1
            return at

        walk(fitted._java_obj.rootNode())
        return made

    def scores(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, low, high = (np.array(a) for a in (self.feature, self.threshold, self.low, self.high))
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while (feature[at] >= 0).any():
            at = np.where(x[rows, feature[at]] <= threshold[at], low[at], high[at])  # a leaf leads to itself
        return np.array(self.value)[at]


def share_of(seed: int, *keys: str) -> Column:
    return sampling.order_of(seed, *keys) / F.lit(float(1 << 32))


@dataclass
class LambdaRanker:
    config: RankerConfig = field(default_factory=RankerConfig)
    features: tuple[str, ...] = fixed.FEATURES
    trees: list[Tree] = field(default_factory=list)
    gains: list[list[float]] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)

    def _bag(self, rows: DataFrame, n: int, seed: int) -> DataFrame:
        """The rows that round n fits on (boosting.Part draws the same): bagging_fraction of all, and of the irrelevant ones neg_bagging_fraction; drawn anew every bagging_freq rounds."""
        if not self.config.bagging_freq:
            return rows
        turn = seed + n // self.config.bagging_freq
        kept = share_of(turn, "qid", "pid") < self.config.bagging_fraction
        return rows.where(kept & ((F.col("relevance") > 0) | (share_of(turn + 7919, "qid", "pid") < self.config.neg_bagging_fraction)))

    def fit(self, train: DataFrame, val: DataFrame, seed: int = 42) -> LambdaRanker:
        table = boosting.parts(train, val, list(self.features))
        if table.count() == 1:
            told = boosting.each(table, lambda part: self._boost(boosting.Here(part), seed)).first()["data"]
            self.trees, self.gains, self.history = pickle.loads(told)
        else:
            self.trees, self.gains, self.history = self._boost(boosting.Spread(table), seed)
        return self

    def _boost(self, data: boosting.Here | boosting.Spread, seed: int) -> tuple[list[Tree], list[list[float]], list[dict]]:
        config, width = self.config, len(self.features)
        cuts = boosting.edges(data.values())
        trees, gains, history = [], [], []
        best, best_round = -1.0, 0
        for n in range(config.rounds):
            drawn = np.random.default_rng(seed + n).choice(width, max(1, round(config.feature_fraction * width)), replace=False)
            columns = sorted(int(c) for c in drawn)
            data.change("start", cuts, trees[-1] if trees else None, seed + n // config.bagging_freq if config.bagging_freq else None, config)
            grown = boosting.grow(data, cuts, columns, config, width)
            if grown is None:  # an empty bag
                data.change("start", cuts, None, None, config)
                grown = boosting.grow(data, cuts, columns, config, width)
            if grown is None:
                raise ValueError("no training rows")
            trees.append(Tree(**grown[0]))
            gains.append(grown[1])
            if (n + 1) % MEASURE == 0 or n + 1 == config.rounds:
                (train, train_n), (val, val_n) = data.total("metric", trees[-1], 5).tolist()
                history.append({"round": n + 1, "train": train / train_n if train_n else 0.0, "val": val / val_n if val_n else 0.0})
                if history[-1]["val"] > best + 1e-12:  # more than the order of a sum can make
                    best, best_round = history[-1]["val"], n + 1
                elif n + 1 - best_round >= config.early_stopping_rounds:
                    break
        return trees[:best_round], gains[:best_round], history

    def scores(self, x: np.ndarray, trees: list[Tree] | None = None) -> np.ndarray:
        """Scores of a matrix whose columns are the features; needs no Spark."""
        total = np.zeros(len(x))
        for tree in self.trees if trees is None else trees:
            total += tree.scores(x)
        return total

    def _scored(self, rows: DataFrame, trees: list[Tree], column: str) -> DataFrame:
        """rows with the trees' sum added to column."""
        names, order = list(self.features), rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.column_stack([np.asarray(batch.column(order.index(c)).to_numpy(zero_copy_only=False), np.float64) for c in names])
                own = batch.column(order.index(column)).to_numpy(zero_copy_only=False) + self.scores(x, trees)
                yield pa.RecordBatch.from_arrays([pa.array(own) if c == column else batch.column(k) for k, c in enumerate(order)], names=order)

        return rows.mapInArrow(run, rows.schema)

    def predict(self, rows: DataFrame, column: str = "score") -> DataFrame:
        """rows with their scores: one pass of NumPy over each batch, for any number of trees."""
        return self._scored(rows.withColumn(column, F.lit(0.0)), self.trees, column)

    def importances(self, spark: SparkSession) -> DataFrame:
        """(feature, importance), the largest first; zeros are listed as well."""
        total = np.sum(self.gains, axis=0) if self.gains else np.zeros(len(self.features))
        whole = float(total.sum()) or 1.0
        return spark.createDataFrame([(n, float(v) / whole) for n, v in zip(self.features, total, strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")

    def diagnostics(self, spark: SparkSession) -> DataFrame:
        """Of each measured round the metrics, their gap and its verdict."""
        rows = spark.createDataFrame([(h["round"], h["train"], h["val"]) for h in self.history], "round int, train double, val double")
        return gap_verdict(rows)

    def to_json(self) -> str:
        return json.dumps({"features": list(self.features), "trees": [vars(t) for t in self.trees], "gains": self.gains, "history": self.history})

    @classmethod
    def of_json(cls, text: str, config: RankerConfig | None = None) -> LambdaRanker:
        made = json.loads(text)
        return cls(config or RankerConfig(), tuple(made["features"]), [Tree(**t) for t in made["trees"]], made["gains"], made["history"])

    def save(self, base: str, name: str) -> None:
        spark = SparkSession.active()
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(inside(base, name))

    @classmethod
    def load(cls, base: str, name: str, config: RankerConfig | None = None) -> LambdaRanker:
        return cls.of_json(SparkSession.active().read.text(inside(base, name)).first()[0], config)

    def export(self, path: str) -> None:
        """One JSON file that of_json() loads, with or without Spark."""
        Path(path).write_text(self.to_json())


def gap_verdict(rows: DataFrame) -> DataFrame:
    gap = F.col("train") - F.col("val")
    return rows.withColumn("gap", gap).withColumn("verdict", F.when(gap > 0.05, "overfit").when(gap > 0.02, "mild").otherwise("good"))
