"""Texts from a generator of one's own (a language model behind a function), with a breaker and a cache.

The generator is a function from a prompt to an answer or None. It runs inside the tasks; a task that has met FAILURES
failures in a row asks no more. Answers that hold a JSON object are parsed; rows without an answer keep their fallback.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.stores import inside

FAILURES = 3
_OBJECT = re.compile(r"\{.*\}", re.DOTALL)


def json_in(text: str | None) -> dict[str, str] | None:
    """The object that stands in a text, its values as strings; None where there is none or it does not parse."""
    found = _OBJECT.search(text or "")
    if not found:
        return None
    try:
        made = json.loads(found.group())
    except ValueError:
        return None
    return {str(k): v if isinstance(v, str) else json.dumps(v) for k, v in made.items() if v is not None}


def generate(rows: DataFrame, ask: Callable[[str], str | None], failures: int = FAILURES) -> DataFrame:
    """(key, made map<string,string>) of rows (key, prompt): what the generator answered, null where it did not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        missed = 0
        for batch in batches:
            made = []
            for prompt in batch.column("prompt").to_pylist():
                answer = None
                if missed < failures:
                    try:
                        answer = json_in(ask(prompt))
                    except Exception:  # a failing service must not fail the task
                        answer = None
                    missed = 0 if answer is not None else missed + 1
                made.append(None if answer is None else list(answer.items()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(made, pa.map_(pa.string(), pa.string()))], names=["key", "made"])

    return rows.select(F.col("key").cast("string").alias("key"), F.col("prompt").cast("string").alias("prompt")).mapInArrow(run, "key string, made map<string,string>")


def cached(rows: DataFrame, ask: Callable[[str], str | None], base: str, name: str = "generated") -> DataFrame:
    """generate() of the keys that the cache below base does not hold; answers are added to it. Keys without an answer are asked again next time."""
    spark = rows.sparkSession
    path = inside(base, name)
    known = load(spark, path)
    fresh = rows if known is None else rows.join(known.select("key"), "key", "left_anti")
    generate(fresh.dropDuplicates(["key"]), ask).where("made is not null").write.mode("append").parquet(path)
    known = load(spark, path)
    return rows.select("key").distinct().join(known, "key", "left")


def load(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("key string, made map<string,string>").parquet(path)
    except Exception as error:  # no cache yet
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
