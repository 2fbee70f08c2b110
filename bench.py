"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores. Each query runs once to warm up and then BENCH_RUNS times
(default 3) into the noop sink; the best run counts. ``rates`` gives files and
megabytes of source text per second.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

from checks.compare import local_session
from checks.queries import QUERIES, _files

HEADLINE = (
    "strip_comments_regex",
    "strip_comments_lexical",
    "pages_strip_html",
    "chunk_files",
    "build_requests",
    "document_corpus",
    "review_corpus",
    "apply_spans",
    "apply_spans_sparse",
    "review_stripped",
    "preservation_audit",
    "plan_summary",
)


def spread_copy(spark, sf_dir: str, parts: int) -> str:
    """The tables that the queries read, in as many files as there are cores: each given one is a single split."""
    target = tempfile.mkdtemp(prefix="bench-")
    for name in ("documents", "pages", "conversations"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(parts).write.parquet(f"{target}/{name}.parquet")
    return target


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores)
    sf = os.path.basename(sf_dir.rstrip("/"))
    sf_dir = spread_copy(spark, sf_dir, int(cores))
    files, size = _files(spark, sf_dir).agg(F.count("*"), F.sum(F.octet_length("content"))).first()
    best = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        best[name] = round(min(times[1:]), 3)
    rates = {
        name: {"files_per_sec": round(files / sec), "mb_per_sec": round(size / sec / 1e6, 1)}
        for name, sec in best.items()
        if name != "pages_strip_html"
    }
    if "pages_strip_html" in best:
        pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
        rates["pages_strip_html"] = {"pages_per_sec": round(pages / best["pages_strip_html"])}
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of best times",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": best,
                "sf": sf,
                "cpus": int(cores),
                "source_mb": round(size / 1e6, 1),
                "rates": rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
