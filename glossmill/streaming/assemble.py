"""Files from responses that arrive on a stream."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from glossmill.config import RESPONSES, JobConfig
from glossmill.operators.responses import judged, sources_of
from glossmill.sources.workspace import keep

_GATHERED = "path string, indices array<int>, outputs array<string>, errors array<string>"
# Of each file of a bucket: its path, when it is given up, whether it came out, its number of responses; then all responses.
_HELD = "paths array<string>, due array<bigint>, done array<boolean>, sizes array<int>, indices array<int>, outputs array<string>, errors array<string>"
#: Files share their state by the hash of their path: a call of python costs more than the few responses of a file. Part of a
#: stream's checkpoint, so never to be changed for one that goes on.
BUCKETS = 1 << 13


def _gate(wait_ms: int) -> Any:
    """Holds files' responses until every chunk has an answer, or none came for a while; a call sees the files of one bucket."""

    def order(told: tuple) -> tuple:
        # An answer comes before an error, then the least text.
        return (told[1] is not None, told[0] is not None, told[0] or "", told[1] or "")

    def restored(state: Any) -> dict[str, list]:
        paths, due, done, sizes, *columns = state.get if state.exists else ([], [], [], [], [], [], [])
        told = zip(*columns)
        return {p: [t, over, {i: (output, error) for i, output, error in islice(told, n)}] for p, t, over, n in zip(paths, due, done, sizes)}

    def gate(key: tuple, frames: Iterator[Any], state: Any) -> Iterator[Any]:
        import pandas as pd

        now, files, out, touched = state.getCurrentProcessingTimeMs(), restored(state), [], {}
        for frame in () if state.hasTimedOut else frames:
            frame = frame[["path", "n_chunks", "chunk_index", "output", "error"]].astype(object)
            frame = frame.where(frame.notna(), None)
            for path, wanted, i, output, error in zip(*(frame[c] for c in frame.columns)):
                file = files.setdefault(path, [0, False, {}])
                file[0] = now + wait_ms
                touched.setdefault(path, wanted)
                # What comes after a file came out changes nothing; that it did is remembered as long as others would wait.
                if not file[1]:
                    told = (output, error)
                    file[2][int(i)] = min(file[2].get(int(i), told), told, key=order)
        for path, wanted in touched.items():
            file = files[path]
            if not file[1] and wanted and all(i in file[2] and file[2][i][1] is None for i in range(int(wanted))):
                out.append((path, file[2]))
                file[1:] = True, {}
        for path in [p for p, file in files.items() if file[0] < now or (state.hasTimedOut and file[0] == now)]:
            _, done, held = files.pop(path)
            if not done:
                out.append((path, held))
        if out:
            places = [sorted(held) for _, held in out]
            yield pd.DataFrame(
                {
                    "path": [path for path, _ in out],
                    "indices": places,
                    "outputs": [[held[i][0] for i in there] for (_, held), there in zip(out, places)],
                    "errors": [[held[i][1] for i in there] for (_, held), there in zip(out, places)],
                }
            )
        if not files:
            state.remove()
            return
        rows = [(i, *held[i]) for _, _, held in files.values() for i in sorted(held)]
        state.update(
            (
                list(files),
                [due for due, _, _ in files.values()],
                [done for _, done, _ in files.values()],
                [len(held) for _, _, held in files.values()],
                *([row[k] for row in rows] for k in range(3)),
            )
        )
        state.setTimeoutDuration(max(1, min(due for due, _, _ in files.values()) - now))

    return gate


def assemble_arriving(files: DataFrame, responses: DataFrame, config: JobConfig = JobConfig(), wait_ms: int = 3_600_000) -> DataFrame:
    """``assemble``'s rows on a stream of ``(path, chunk_index, output, error)``, for files that were asked about.

    A file comes out when the last of its chunks has an answer. One whose chunks failed, or are missing, comes out
    when nothing came for it for ``wait_ms``, with the error that a batch gives it; until then a later answer still
    counts. Responses to files that are not among ``files`` are left out, as are those without an index; later
    responses to a file that came out change nothing. Blank files are not asked about and do not come out. The
    state is files' responses, those of a bucket of files in one row; ``files`` is a static table, of which only paths,
    lengths and numbers of chunks are joined with the stream. These are written down first: every batch reads them.
    """
    source = keep(sources_of(files, config), "sources")
    asked = source.where("source_length > 0").select("path", "n_chunks")
    named = responses.where("chunk_index is not null").join(asked, "path").select("path", "chunk_index", "output", "error", "n_chunks")
    dealt = named.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int"))
    gathered = dealt.groupBy("bucket").applyInPandasWithState(
        _gate(wait_ms), _GATHERED, _HELD, "append", GroupStateTimeout.ProcessingTimeTimeout
    )

    def answer(index: Column, place: Column) -> Column:
        error = F.get(F.col("errors"), place)
        return F.struct(
            index.alias("chunk_index"), error.isNotNull().alias("failed"), F.get(F.col("outputs"), place).alias("output"), error.alias("error")
        )

    return judged(gathered.select("path", F.transform("indices", answer).alias("answers")).join(source, "path"), config)


def assemble_available(
    files: DataFrame, source: str, target: str, checkpoint: str, config: JobConfig = JobConfig(), files_per_batch: int = 1_000
) -> None:
    """``assemble_arriving`` over parquet files of responses that have landed in ``source``: takes what is there, appends to
    ``target`` and ends. A file that still waits is held in ``checkpoint`` for the next time."""
    spark, setting = files.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    arriving = spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    out = assemble_arriving(files, arriving, config).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    before = spark.conf.get(setting)
    # Batches without data are for what fails by time; a run that ends would make them for ever.
    spark.conf.set(setting, "false")
    try:
        query = out.trigger(availableNow=True).start(target)
    finally:
        spark.conf.set(setting, before)
    query.awaitTermination()
