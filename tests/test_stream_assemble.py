"""Files from responses on a stream: as a batch gives them, once, in any order, and by time."""

import random
import time

import pytest
from pyspark.sql import functions as F

from glossmill.config import RESPONSES, JobConfig
from glossmill.operators.chunks import chunks
from glossmill.operators.responses import assemble
from glossmill.streaming import assemble as streaming
from glossmill.streaming.assemble import assemble_arriving, assemble_available

TEXT = "\n\ndef f():\n    a\n"
FILES = [(f"p{i}.py", "python", TEXT * (i % 4 + 1)) for i in range(30)] + [("blank.py", "python", " \n")]
CONFIG = JobConfig(min_lines=2)


def files_of(spark):
    return spark.createDataFrame(FILES, "path string, language string, content string")


def responses_of(spark):
    places = sorted((r.path, r.chunk_index) for r in chunks(files_of(spark).where("path <> 'blank.py'"), CONFIG.min_lines).collect())
    return [(p, i, f"answer {p} {i} " + "x" * 40, None) for p, i in places]


def run(spark, tmp_path, batches, wait_ms=3_600_000, until=None):
    """Rows that come out after each batch of responses."""
    landing, target = str(tmp_path / "landing"), str(tmp_path / "target")
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, RESPONSES).coalesce(1).write.mode("append").parquet(landing)
        time.sleep(0.02 if number else 0)
    if until is None:
        assemble_available(files_of(spark), landing, target, str(tmp_path / "progress"), CONFIG, files_per_batch=1)
        return sorted(map(tuple, spark.read.schema(query_schema(spark)).parquet(target).collect()))
    stream = spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", 1).parquet(landing)
    out = assemble_arriving(files_of(spark), stream, CONFIG, wait_ms).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "progress"))
    query, end = out.trigger(processingTime="500 milliseconds").start(target), time.monotonic() + 90
    try:
        while time.monotonic() < end and not until(spark.read.schema(query_schema(spark)).parquet(target) if query.lastProgress else None):
            assert query.exception() is None
            time.sleep(0.5)
    finally:
        query.stop()
    return sorted(map(tuple, spark.read.schema(query_schema(spark)).parquet(target).collect()))


def query_schema(spark):
    return assemble(files_of(spark), spark.createDataFrame([], RESPONSES), CONFIG).schema


def batch(spark, rows):
    return sorted(map(tuple, assemble(files_of(spark), spark.createDataFrame(rows, RESPONSES), CONFIG).where("path <> 'blank.py'").collect()))


def test_a_stream_equals_the_batch(spark, tmp_path):
    rows = responses_of(spark)
    random.Random(1).shuffle(rows)
    # Copies, responses to files nobody asked about, and an error that an answer follows.
    told = [rows[0], ("other.py", 0, "x", None), (rows[-1][0], rows[-1][1], None, "busy")]
    got = run(spark, tmp_path, [told, rows[: len(rows) // 2], rows[len(rows) // 2 :], rows[:9]])
    want = batch(spark, rows)
    assert got == want and len(got) == 30 and all(r[2] for r in got)


def test_what_fails_comes_out_by_time(spark, tmp_path):
    rows = [r for r in responses_of(spark) if r[0] in ("p3.py", "p7.py", "p2.py")]
    rows = [(p, i, None, "model error") if (p, i) == ("p3.py", 1) else (p, i, o, e) for p, i, o, e in rows if (p, i) != ("p7.py", 0)]
    got = run(spark, tmp_path, [rows[:2], rows[2:]], wait_ms=4_000, until=lambda df: df is not None and df.count() >= 3)
    want = [r for r in batch(spark, rows) if r[0] in ("p3.py", "p7.py", "p2.py")]
    assert got == want and [r[3] for r in got] == [None, "model error", "responses do not match the chunks"]


@pytest.mark.parametrize("rows", [[], [(None, 0, "x", None), ("p0.py", None, "x", None)]])
def test_odd_responses(spark, tmp_path, rows):
    assert run(spark, tmp_path, [rows]) == []


def test_batches_do_not_read_the_files_again(spark, tmp_path, monkeypatch):
    """Each batch cut all files into chunks anew, twice; and files share a bucket's state."""
    monkeypatch.setattr(streaming, "BUCKETS", 2)
    reads, landing = spark.sparkContext.accumulator(0), str(tmp_path / "landing")

    @F.udf("string")
    def counted(text):
        reads.add(1)
        return text

    rows = responses_of(spark)
    random.Random(2).shuffle(rows)
    for k in range(3):
        spark.createDataFrame(rows[k::3], RESPONSES).coalesce(1).write.mode("append").parquet(landing)
    files = files_of(spark).withColumn("content", counted("content"))
    assemble_available(files, landing, str(tmp_path / "target"), str(tmp_path / "progress"), CONFIG, files_per_batch=1)
    got = sorted(map(tuple, spark.read.schema(query_schema(spark)).parquet(str(tmp_path / "target")).collect()))
    assert got == batch(spark, rows) and len(got) == 30
    assert reads.value == len(FILES)


def test_files_of_one_bucket_wait_by_themselves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming, "BUCKETS", 1)
    test_what_fails_comes_out_by_time(spark, tmp_path)
