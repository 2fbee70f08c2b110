"""Run queries on both engines and compare the rows, in any order."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


def local_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Python workers find the package wherever the session was started from.
    paths = [str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")]
    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, paths))
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def spark_rows(df: DataFrame) -> Counter:
    columns = sorted(df.columns)
    return Counter(tuple(row) for row in df.select(*columns).collect())


def duck_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(row[i] for i in order) for row in cursor.fetchall())


def main(sf_dir: str, *names: str) -> int:
    from checks.oracles import ORACLES
    from checks.queries import QUERIES

    spark, con, bad = local_session(), database(sf_dir), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            ours = spark_rows(df)
            middle = time.time()
            columns, theirs = duck_rows(con, ORACLES[name]) if name in ORACLES else (sorted(df.columns), ours)
            verdict = "ok" if columns == sorted(df.columns) and ours == theirs else "DIFFERENT"
            print(f"{verdict:10} {name:24} rows {sum(ours.values()):7} spark {middle - start:6.2f}s sql {time.time() - middle:6.2f}s", flush=True)
            if verdict != "ok":
                bad += 1
                print("  columns", sorted(df.columns), columns)
                for label, extra in (("spark only", ours - theirs), ("sql only", theirs - ours)):
                    print(" ", label, sum(extra.values()), [tuple(str(v)[-300:] for v in r) for r in list(extra)[:2]])
        except Exception as cause:  # noqa: BLE001
            bad += 1
            print(f"FAILED     {name}: {str(cause)[:1500]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
