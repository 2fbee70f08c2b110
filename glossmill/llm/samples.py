"""Samples of a fixed size that depend on the texts alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_least_hash(df: DataFrame, text: str, rows: int) -> DataFrame:
    """A row for each of the ``rows`` distinct texts whose hashes are least; all of them where there are fewer.

    Which texts these are does not depend on how many there are, nor on how often one is there. Only hashes are
    sorted; texts are shuffled where their hash is among the least. Of rows with one hash any one is taken.
    """
    hashed = df.withColumn("__hash", F.xxhash64(text))
    least = hashed.select("__hash").distinct().orderBy("__hash").limit(rows).agg(F.max("__hash").alias("last")).first()["last"]
    if least is None:
        return df.limit(0)
    return hashed.filter(F.col("__hash") <= least).dropDuplicates(["__hash"]).drop("__hash")
