"""A query set against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A query set of at most so many rows is broadcast; a larger one is dealt in blocks.
BROADCAST_QUERIES = 20_000


def against_all(rows: DataFrame, queries: DataFrame, key: str, blocks: int = 32) -> DataFrame:
    """Every row with every query of a query set. The queries are counted: few are broadcast; many are cut into
    blocks by their key that meet the rows in an equi-join."""
    if queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        return rows.crossJoin(F.broadcast(queries))
    left = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.join(queries.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")), "_block").drop("_block")
