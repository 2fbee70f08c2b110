"""Exact deduplication against plain grouping, and the cuckoo filter against a set."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import database, duck_rows, spark_rows
from glossmill.llm import exact_dedup, oracles, queries
from glossmill.sources.workspace import work_dir

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string"


def keys(n, seed=1):
    return np.random.default_rng(seed).integers(-(2**63), 2**63, n, dtype=np.int64)


def test_filter_forgets_only_what_is_taken_out():
    known, others = keys(20_000), keys(20_000, 2)
    held = exact_dedup.CuckooFilter.of(known)
    assert held.has(known).all() and held.has(others).mean() < 0.002
    assert (held.slots > 0).sum() == len(known)
    held = exact_dedup.CuckooFilter.read(held.write())
    held.remove(known[:15_000])
    assert held.has(known[15_000:]).all() and held.has(known[:15_000]).mean() < 0.002
    assert held.add(others[:15_000]) and held.has(others[:15_000]).all() and held.has(known[15_000:]).all()


def test_filter_overflows_and_is_made_anew(monkeypatch):
    small = exact_dedup.CuckooFilter.empty(4)
    assert small.add(keys(5)) and not small.add(keys(100, 3))
    for moves in (500, 1):
        monkeypatch.setattr(exact_dedup, "MAX_MOVES", moves)
        assert exact_dedup.CuckooFilter.empty(64).add(keys(250, 4)) == (moves == 500)
        for n in (0, 1, 2, 63, 64, 65, 1000):
            assert exact_dedup.CuckooFilter.of(keys(n)).has(keys(n)).all()


def test_alike_prints_are_held_apart():
    """Two keys that leave the same bits in the same places: one may go, the other stays known."""
    held = exact_dedup.CuckooFilter.empty(1)
    many = keys(400_000, 5)
    prints = held._places(many)[0]
    print_ = Counter(prints.tolist()).most_common(1)[0][0]
    one, two = many[prints == print_][:2]
    assert held.add(np.array([one])) and held.has(np.array([two])).all()
    assert held.add(np.array([two]))
    held.remove(np.array([one]))
    assert held.has(np.array([two])).all()


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def plain(rows, shown=None):
    """Groups of ``rows``, of which those at the places ``shown`` are returned."""
    import hashlib

    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(t or "", []).append((d is not None, d, i))
    out = []
    for t, members in groups.items():
        last = max(members, key=lambda m: (m[0], m[1] or 0, m[2]))
        digest = hashlib.sha256(t.encode()).hexdigest()
        out += [(d, last[1], len(members), i == last[2], digest) for _, d, i in members if shown is None or i in shown]
    return sorted(out, key=str)


ROWS = [
    (1, None), (2, ""), (3, "a"), (4, "a"), (4, "a"), (5, "A"), (None, "b"), (None, "b"), (None, "a"), (6, "word " * 50_000),
    (7, "word " * 50_000), (8, " a"), (9, "é"), (10, "é"), (-3, "c"), (-2, "c"), (None, None),
]


def test_odd_rows(spark):
    df = spark.createDataFrame(ROWS, DOC).repartition(3).withColumns({c: F.lit("mine") for c in ("key", "sha", "row", "gen", "marked", "id")})
    got = exact_dedup.duplicates(df, work_dir(spark, "index"))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    # Which of the equal rows stays is open: as many as are kept, for each row.
    assert Counter(rows_of(got)) == Counter(plain(ROWS))
    assert exact_dedup.duplicates(df.filter("false"), work_dir(spark, "index")).count() == 0
    lower = exact_dedup.duplicates(df, work_dir(spark, "index"), normalise=lambda c: F.lower(F.trim(c)))
    assert {r.group_size for r in lower.filter("doc_id in (3, 5, 8)").collect()} == {6}


@pytest.mark.parametrize("bits", [0, 3])
def test_changes_over_time(spark, bits):
    """Batches come and documents go; after each change the index says what plain grouping says."""
    rng, path = random.Random(bits), work_dir(spark, "index")
    index, live = exact_dedup.create(spark, path, bits=bits), []
    for step in range(4):
        batch = [(1000 * step + i, f"text {rng.randrange(40 * (step + 1))}") for i in range(60)]
        index, got = exact_dedup.insert(index, spark.createDataFrame(batch, DOC))
        live += batch
        shown = set(range(len(live) - len(batch), len(live)))
        assert rows_of(got) == plain(live, shown)
        gone = set(rng.sample([d for d, _ in live], 45))
        index = exact_dedup.delete(index, spark.createDataFrame([(d,) for d in [*gone, -1, None]], "doc_id bigint"))
        live = [r for r in live if r[0] not in gone]
        index = exact_dedup.open_index(spark, path)
        assert rows_of(exact_dedup.live_groups(index)) == plain(live)
        asked = [(i, f"text {i}") for i in range(200)]
        held = {t for _, t in live}
        told = exact_dedup.known(index, spark.createDataFrame(asked, DOC)).collect()
        assert {r.doc_id: r.known for r in told} == {i: t in held for i, t in asked}
        stored = [exact_dedup.CuckooFilter.read(bytes(r.slots)) for r in index.filters().collect()]
        assert sum(int((f.slots > 0).sum()) for f in stored) == len(held)


def test_digests_that_collide(spark, monkeypatch):
    """Texts, not digests, decide: with one digest for all of them the groups are the same."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.length("text").cast("bigint"))
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "c")]
    path = work_dir(spark, "index")
    index, got = exact_dedup.insert(exact_dedup.create(spark, path), spark.createDataFrame(rows, DOC))
    assert rows_of(got) == plain(rows)
    more = [(5, "bb"), (6, "dd"), (7, "c")]
    _, got = exact_dedup.insert(index, spark.createDataFrame(more, DOC))
    assert rows_of(got) == plain(rows + more, {4, 5, 6})


def test_filters_that_overflow_are_made_from_stored_digests(spark):
    index, _ = exact_dedup.insert(exact_dedup.create(spark, work_dir(spark, "index"), bits=1), spark.createDataFrame([(0, "first")], DOC))
    many = spark.range(1, 5001).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    index, got = exact_dedup.insert(index, many)
    assert got.filter("group_size <> 1 or not kept").count() == 0
    stored = {r.bucket: exact_dedup.CuckooFilter.read(bytes(r.slots)) for r in index.filters().collect()}
    assert len(stored) == 2 and sum(int((f.slots > 0).sum()) for f in stored.values()) == 5001
    told = exact_dedup.known(index, many.union(spark.createDataFrame([(0, "first"), (-1, "none")], DOC)))
    assert [r.doc_id for r in told.filter("not known").collect()] == [-1]


def test_a_change_that_did_not_end_is_none(spark):
    path = work_dir(spark, "index")
    index, _ = exact_dedup.insert(exact_dedup.create(spark, path), spark.createDataFrame([(1, "a")], DOC))
    spark.createDataFrame([(0, 9, 1, "x")], "row bigint, id bigint, key bigint, sha string").write.parquet(index.part("members", 1))
    index = exact_dedup.open_index(spark, path)
    assert index.generation == 0 and index.members().count() == 1
    index, got = exact_dedup.insert(index, spark.createDataFrame([(2, "a")], DOC))
    assert [(r.keep_id, r.group_size, r.kept) for r in got.collect()] == [(2, 2, True)] and index.members().count() == 2


def test_query_against_sql(spark):
    df = queries.op11_exact_dedup(spark, SF)
    columns, want = duck_rows(database(SF), oracles.ORACLES["op11_exact_dedup"])
    assert sorted(df.columns) == columns and spark_rows(df) == want
