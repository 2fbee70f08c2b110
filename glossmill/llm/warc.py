"""WARC archives: written with an index first, read by coalesced byte ranges.

Records are gzip members of their own, one after the other in archives of bounded
size. While they are written, each record's archive, offset, length, URL and digest
go to an index table; a reader selects in the index, sorts what it wants by archive
and offset, merges neighbours into ranges and reads each range at once.

A payload that comes again is written as a revisit of one response: its headers
say what the payload was, and to which record they refer.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.sources.workspace import keep, root_opener, work_dir

#: Smaller payloads are written each time.
REVISIT_FROM = 1_000
ARCHIVE_BYTES = 64 << 20
#: Records are read together if no more than this lies between them, up to this much at once.
GAP_BYTES, RANGE_BYTES = 64 << 10, 8 << 20
#: Bytes for one reading task, about.
TASK_BYTES = 64 << 20

_INDEX = "page_id bigint, url string, record_type string, archive string, offset bigint, length bigint, payload_digest string"
_RECORD = "archive string, offset bigint, page_id bigint, record_type string, url string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def _header(value: str) -> str:
    """A header's value on one line: control characters and percent signs before them are escaped."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number and number != "none" else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member, the same bytes each time."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_id(page_id)}",
        f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {_header(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_id(refers_to)}"] if revisit else []),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {0 if revisit else len(payload)}",
    ]
    body = "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(body) + packer.flush()


def parse(member: bytes) -> dict:
    """A record from its gzip member."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    payload = rest[: int(headers["Content-Length"])]
    return {
        "page_id": _page(headers["WARC-Record-ID"]),
        "record_type": headers["WARC-Type"],
        "url": headers.get("WARC-Target-URI"),
        "refers_to": _page(headers.get("WARC-Refers-To")),
        "payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": int(headers["X-Payload-Length"]),
        "payload": payload if headers["WARC-Type"] == "response" else None,
    }


def _writer(root: str, archive_bytes: int):
    open_root = root_opener(root)

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        system, base = open_root()
        system.create_dir(base, recursive=True)
        name, out, at = "", None, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, digest, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        # A name of its own for each attempt: a repeated task never writes over what another wrote.
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    member = record(page_id, url, payload, digest, refers_to, revisit)
                    out.write(member)
                    rows.append((page_id, url, "revisit" if revisit else "response", name, at, len(member), digest))
                    at += len(member)
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                names = [f.split()[0] for f in _INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(
    pages: DataFrame, root: str, id: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = REVISIT_FROM, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write a record for each row under ``root``, a new folder all executors see; returns the index.

    A null payload is empty, a null URL has no header, a null id is written as none.
    Of equal payloads of ``revisit_from`` bytes or more the one with the greatest id
    is a response, and the others revisit it; of repeated rows with that id, and
    where all ids are null, each is a response. The index is a written table.

    Copies are found by digest and length, counted before they are shuffled. Then
    pages are joined with a written table of the payloads that occur more than once,
    on the digest, whose large groups are split as skewed keys.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    known = pages.select(F.col(id).cast("bigint").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    known = known.withColumn("digest", F.sha1("payload"))
    large = known.filter(F.octet_length("payload") >= revisit_from)
    copies = large.groupBy("digest", F.octet_length("payload").alias("__bytes")).agg(F.max("page_id").alias("head"), F.count("*").alias("__n")).filter("__n > 1 and head is not null")
    joined = known.join(keep(copies.select("digest", "head"), "warc-copies"), "digest", "left")
    is_head = F.col("head").isNull() | F.coalesce(F.col("page_id") == F.col("head"), F.lit(False))
    rows = joined.select("page_id", "url", "payload", "digest", F.when(~is_head, F.col("head")).alias("refers_to"), (~is_head).alias("revisit"))
    return keep(rows.mapInArrow(_writer(root, archive_bytes), _INDEX), "warc-index")


def _reader(root: str):
    open_root = root_opener(root)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        system, base = open_root()
        kind = pa.schema(
            [("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string())]
            + [("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
        )
        for batch in batches:
            for archive, start, end, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_file(f"{base}/{archive}") as file:
                    file.seek(start)
                    data = file.read(end - start)
                out = []
                for r in records:
                    at = r["offset"] - start
                    out.append({"archive": archive, "offset": r["offset"]} | parse(data[at : at + r["length"]]))
                yield pa.RecordBatch.from_pylist(out, kind)

    return read


def ranges(selected: DataFrame, gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> DataFrame:
    """``(archive, start, end, records)``: selected index rows, neighbours merged.

    Records of one archive are merged where at most ``gap`` bytes lie between them; a
    range begins anew at every ``most`` bytes of the archive. An archive's rows are
    sorted in one place; archives have a bounded size.
    """
    by_offset = Window.partitionBy("archive").orderBy("offset")
    end = F.col("offset") + F.col("length")
    apart = (F.col("offset") - F.lag(end).over(by_offset) > gap) | (F.floor(F.col("offset") / most) > F.floor(F.lag("offset").over(by_offset) / most))
    numbered = selected.select("archive", "offset", "length").distinct().withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
    numbered = numbered.withColumn("run", F.sum("new").over(by_offset))
    return (
        numbered.groupBy("archive", "run")
        .agg(F.min("offset").alias("start"), F.max(end).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))
        .select("archive", "start", "end", "records")
    )


def read_records(selected: DataFrame, root: str, gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> DataFrame:
    """The records that ``selected`` rows of an index point to, each once.

    Tasks are as many as the bytes need, not the few that an index of small rows
    would be given. A revisit has no payload; its digest and length are its
    response's.
    """
    spark = selected.sparkSession
    size = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, size // TASK_BYTES + 1)
    return ranges(selected, gap, most).repartition(int(tasks), "archive", "start").mapInArrow(_reader(root), _RECORD)


def archive_folder(df: DataFrame) -> str:
    """A new folder for archives, under the shared folder."""
    return work_dir(df.sparkSession, "warc")
