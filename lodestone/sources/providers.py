"""Where vectors come from: hashed words, a table of given vectors, or an encoder of one's own.

A provider gives vectors(rows, key, text): the distinct keys of rows with a unit vector each, as (key, vector)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors as V


class Embeddings(Protocol):
    dimension: int

    def vectors(self, rows: DataFrame, key: str, text: str) -> DataFrame: ...


@dataclass(frozen=True)
class HashedWords:
    """Counts of words by hash bucket: the stand-in where no model's vectors are given."""

    dimension: int = 64

    def vectors(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        return rows.select(F.col(key).alias("key"), V.hashed_embedding(T.tokens(F.col(text)), self.dimension).alias("vector"))


@dataclass(frozen=True)
class Given:
    """A table (text, embedding); a text without a vector gets none and is never found."""

    table: DataFrame
    dimension: int

    def vectors(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        known = self.table.select(F.col("text").alias("_text"), V.unit(F.col("embedding")).alias("vector"))
        return rows.select(F.col(key).alias("key"), F.col(text).alias("_text")).join(known, "_text").select("key", "vector")


@dataclass(frozen=True)
class Encoded:
    """Vectors of a function from a list of texts (at most LIMIT characters each) to an array (texts, dimension), called batch by batch."""

    encode: Callable[[list[str]], np.ndarray]
    dimension: int
    limit: int = 512

    def vectors(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        asked = rows.select(F.col(key).alias("key"), T.truncate(F.coalesce(F.col(text), F.lit("")), self.limit).alias("text"))
        kind = asked.schema["key"].dataType.simpleString()
        encode, dimension = self.encode, self.dimension

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                got = np.asarray(encode(batch.column(1).to_pylist()), np.float64)
                if got.shape != (batch.num_rows, dimension) or not np.isfinite(got).all():
                    raise ValueError(f"the encoder gave {got.shape}, or values that are not finite, for {batch.num_rows} texts of dimension {dimension}")
                size = np.linalg.norm(got, axis=1, keepdims=True)
                got = np.divide(got, size, out=np.zeros_like(got), where=size > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.tolist(), pa.list_(pa.float64()))], names=["key", "vector"])

        return asked.mapInArrow(run, f"key {kind}, vector array<double>")
