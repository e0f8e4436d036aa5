"""Stores: catalog, vectors, metrics; paths stay inside their folder."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inside(base: str, name: str) -> str:
    """base/name, or ValueError where name leads out of base (a sibling with the same prefix included)."""
    scheme, sep, root = base.rpartition("://")
    root = posixpath.normpath(root)
    full = posixpath.normpath(posixpath.join(root, name))
    if full == root or not full.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{name!r} leads out of {base!r}")
    return f"{scheme}{sep}{full}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Where it is unset, a local session (tests) gets one of its own; a cluster's executors share no such folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir and read back."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def save_table(df: DataFrame, base: str, name: str) -> str:
    path = inside(base, name)
    df.write.mode("overwrite").parquet(path)
    return path


def load_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(inside(base, name))


def log_metrics(spark: SparkSession, base: str, run: str, metrics: dict[str, float], params: dict[str, str]) -> None:
    """Append a run's flattened metrics and parameters."""
    rows = [(run, "metric", k, str(v)) for k, v in metrics.items()] + [(run, "param", k, str(v)) for k, v in params.items()]
    spark.createDataFrame(rows, "run string, kind string, name string, value string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(inside(base, "runs"))


def read_feature_json(spark: SparkSession, path: str) -> DataFrame:
    """Feature vectors of a JSON array of objects."""
    return spark.read.json(path, multiLine=True)


def onnx_scores(rows: DataFrame, model_path: str, features: list[str]) -> DataFrame:
    """rows with `score` by an ONNX model, one session a task; the model file must be on every worker."""
    import pandas as pd

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double"

    def run(batches):
        import onnxruntime

        session = onnxruntime.InferenceSession(model_path)
        name = session.get_inputs()[0].name
        for pdf in batches:
            got = session.run(None, {name: pdf[features].to_numpy("float32")})[0].reshape(-1)
            yield pdf.assign(score=pd.Series(got, index=pdf.index, dtype="float64"))

    return rows.mapInPandas(run, schema)
