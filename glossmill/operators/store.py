"""Answers that are kept: equal requests are asked once, and a run goes on where the last one stopped.

A request's digest names it: what is sent, to which model, with which settings. A store
is a folder of answers by digest, to which runs append. What a run asks is the digests
that the store does not have, each once, however many chunks hold the same text; its
responses are the store's answers, dealt out to all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions.bitmaps import BITMAP_BITS, is_set
from glossmill.operators.responses import generate
from glossmill.sources.workspace import keep

ANSWERS = "request_key string, output string"
#: Requests that are asked before their answers are kept, and into how many rounds a large run is dealt at most.
#: A run that dies loses no more than a round.
ROUND_REQUESTS, ROUNDS = 10_000, 64

_SENT = ("provider", "model", "system", "user", "prompt", "messages", "temperature", "max_tokens")


def request_key(requests: DataFrame) -> Column:
    """The digest of all that a model gets to see; where a request came from is no part of it."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in _SENT if c in requests.columns))), 256)


def read_answers(spark: SparkSession, store: str) -> DataFrame:
    """``(request_key, output)`` of a store, one row for each digest; no rows where there is no store yet.

    Of several answers to a digest, which a run that was cut off may have left, the least counts.
    """
    try:
        kept = spark.read.schema(ANSWERS).parquet(store)
    except AnalysisException as cause:
        if cause.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ANSWERS)
    return kept.groupBy("request_key").agg(F.min("output").alias("output"))


def _bounds(missing: DataFrame, rounds: int) -> list[int | None]:
    """Places that cut the missing requests into rounds of about as many; open at both ends."""
    cuts = []
    if rounds > 1:
        shares = [number / rounds for number in range(1, rounds)]
        cuts = sorted(set(missing.agg(F.percentile_approx("request_place", shares)).first()[0]))
    return [None, *cuts, None]


def _due(sent: DataFrame, missing: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """The requests of one round: those at the missing places above ``low`` and up to ``high``.

    Places grow along the files of ``sent``, so a range of them is a few row groups, and the others are not read.
    Which of them are missing is told by a bit for each request, which is sent to every task: no text is shuffled.
    """
    place, bits = F.col("request_place"), BITMAP_BITS.bit_length() - 1
    bucket = F.shiftright(place, bits).alias("bucket")

    def within(df: DataFrame) -> DataFrame:
        df = df if low is None else df.where(place > low)
        return df if high is None else df.where(place <= high)

    position = F.pmod(place, F.lit(BITMAP_BITS))
    bitmaps = within(missing).groupBy(bucket).agg(F.bitmap_construct_agg(position).alias("bitmap"))
    placed = within(sent).withColumn("bucket", bucket).join(F.broadcast(bitmaps), "bucket")
    return placed.where(is_set(F.col("bitmap"), position)).drop("bucket", "bitmap")


def ask(
    requests: DataFrame,
    answer: Callable[[Any], Any],
    store: str,
    batch_size: int = 16,
    partitions: int | None = None,
    round_requests: int = ROUND_REQUESTS,
) -> DataFrame:
    """``generate``'s ``(path, chunk_index, output, error)`` rows, asking only what ``store`` does not know.

    ``store`` is a folder that every executor sees. Answers are appended to it after every ``round_requests``
    requests or so; failures are not, so the next run asks these again. An answer of None is kept as an empty one.
    Requests are written down first: their digests decide, and none is built twice. Of equal requests one is
    asked, and the rows of all share its answer or its error.
    """
    spark = requests.sparkSession
    numbered = requests.withColumn("request_key", request_key(requests)).withColumn("request_place", F.monotonically_increasing_id())
    sent = keep(numbered, "requests", compression="zstd")
    # One place for each digest: no text is shuffled for that, and copies are one row for each task.
    asked = sent.groupBy("request_key").agg(F.min("request_place").alias("request_place"))
    missing = keep(asked.join(read_answers(spark, store), "request_key", "left_anti"), "missing")
    rounds = min(ROUNDS, -(-missing.count() // round_requests))
    usual = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    failures = []
    bounds = _bounds(missing, rounds)
    for low, high in zip(bounds[:-1], bounds[1:]) if rounds else ():
        due = _due(sent, missing, low, high).repartition(usual, "request_key")
        # The digest takes the place of the path, which is what a response is known by.
        named = due.withColumn("path", F.col("request_key")).withColumn("chunk_index", F.lit(0))
        told = keep(generate(named, answer, batch_size), "answers")
        good = told.where("error is null").select(F.col("path").alias("request_key"), F.coalesce("output", F.lit("")).alias("output"))
        good.write.mode("append").parquet(store)
        failures.append(told.where("error is not null").select(F.col("path").alias("request_key"), "error"))
    answers = read_answers(spark, store).withColumn("error", F.lit(None).cast("string"))
    for part in failures:
        answers = answers.unionByName(part.select("request_key", F.lit(None).cast("string").alias("output"), "error"))
    # A written table, so that the rows of a text that is everywhere can be split as a skewed key.
    found = keep(sent.select("request_key").distinct().join(answers, "request_key"), "found")
    return sent.select("path", "chunk_index", "request_key").join(found, "request_key").select("path", "chunk_index", "output", "error")
