"""Exact deduplication with an index of live digests, a cuckoo filter for each bucket.

A text's digest is 64 bits, and its high bits name a bucket. Every bucket has a cuckoo
filter: each digest leaves sixteen bits of itself in one of two places, so it can be
looked up, put in and taken out again. A digest that the filter does not know belongs
to a new text for sure; one that it knows, or that comes several times, is a hit, and
hits are verified against the texts, which are stored by bucket. Where a filter
overflows, a larger one is made from the stored digests.

An index is a folder of written tables, one part for each change: ``members`` (a row
for each document), ``contents`` (each live text once), ``filters``, ``deleted`` and,
written last, ``state``. A change that did not come to its end is as if it had never been.

Texts of documents that are no hits are never compared nor shuffled but to store them,
once each; those of hits are made distinct before the shuffle, so copies cost one row
for each task, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.sources.workspace import keep

#: Digests of one bucket, about, when an index is made. Larger buckets get larger filters.
BUCKET_KEYS = 1 << 10
#: Share of a new filter's places that are taken.
LOAD = 0.85
#: Digests that one insertion moves on before the filter counts as full.
MAX_MOVES = 500
#: Digests of hits are marked in so many bits, which are sent to every task: 16 MB, however many hits.
MARK_BITS = 1 << 27
_BITMAP_BITS = 1 << 15

MEMBERS = "row bigint, id {id}, key bigint, sha string"
CONTENTS = "bucket int, key bigint, sha string, text string"
FILTERS = "bucket int, slots binary"
DELETED = "at int, row bigint"
STATE = "bits int, deletions array<int>"


class CuckooFilter:
    """Sixteen bits of each key, in a free one of the four slots of either of its two places."""

    SLOTS = 4

    def __init__(self, slots):
        self.slots, self.mask = slots, len(slots) - 1

    @classmethod
    def empty(cls, places: int) -> CuckooFilter:
        import numpy as np

        return cls(np.zeros((places, cls.SLOTS), np.uint16))

    @classmethod
    def of(cls, keys, load: float = LOAD) -> CuckooFilter:
        """A filter of all keys, twice as large as long as they overflow it."""
        places = 1 << max(0, int(len(keys) / (cls.SLOTS * load))).bit_length()
        while not (made := cls.empty(places)).add(keys):
            places *= 2
        return made

    @classmethod
    def read(cls, data: bytes) -> CuckooFilter:
        import numpy as np

        return cls(np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())

    def write(self) -> bytes:
        return self.slots.tobytes()

    @staticmethod
    def _mix(x):
        """Spread bits that follow one another over the whole number."""
        import numpy as np

        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def _other(self, print_, at):
        import numpy as np

        return at ^ (self._mix(print_.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def _places(self, keys):
        """What is stored of each key, never 0, and its two places."""
        import numpy as np

        mixed = self._mix(np.asarray(keys, np.int64).view(np.uint64))
        prints = np.maximum(mixed & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
        one = ((mixed >> np.uint64(16)) & np.uint64(self.mask)).astype(np.int64)
        return prints, one, self._other(prints, one)

    def has(self, keys):
        """Whether each key may be stored; False is certain."""
        prints, one, two = self._places(keys)
        return ((self.slots[one] == prints[:, None]) | (self.slots[two] == prints[:, None])).any(axis=1)

    def _fill(self, prints, at):
        """Put what fits into the free slots of its place; which did not fit."""
        import numpy as np

        order = np.argsort(at, kind="stable")
        place = at[order]
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else place
        rank = np.arange(len(place)) - np.repeat(first, np.diff(np.r_[first, len(place)]))
        free = self.slots[place] == 0
        number = np.cumsum(free, axis=1)
        fits = number[:, -1] > rank
        slot = (free & (number == rank[:, None] + 1)).argmax(axis=1)
        self.slots[place[fits], slot[fits]] = prints[order][fits]
        return order[~fits]

    def add(self, keys) -> bool:
        """Store keys that are not stored; False where the filter is full, and then of no more use."""
        prints, one, two = self._places(keys)
        if len(prints) > self.slots.size:
            return False
        left = self._fill(prints, one)
        left = left[self._fill(prints[left], two[left])]
        return all(self._move(prints[i : i + 1], int(two[i])) for i in left)

    def _move(self, print_, at: int) -> bool:
        """Make room by moving what is there to its other place."""
        for step in range(MAX_MOVES):
            free = (self.slots[at] == 0).nonzero()[0]
            if len(free):
                self.slots[at, free[0]] = print_[0]
                return True
            slot = (step * 7 + int(print_[0])) % self.SLOTS
            moved = self.slots[at, slot : slot + 1].copy()
            self.slots[at, slot] = print_[0]
            print_, at = moved, self._other(moved, at).item()
        return False

    def remove(self, keys) -> None:
        """Take stored keys out; each leaves once."""
        prints, one, two = self._places(keys)
        for print_, *places in zip(prints, one, two):
            for at in places:
                held = (self.slots[at] == print_).nonzero()[0]
                if len(held):
                    self.slots[at, held[0]] = 0
                    break


@dataclass(frozen=True)
class Index:
    """A state of an index: parts up to ``generation`` count (-1: none). Changes return the next state."""

    spark: SparkSession
    path: str
    id_type: str = "bigint"
    generation: int = -1
    bits: int = 0
    deletions: tuple[int, ...] = ()

    def part(self, table: str, generation: int) -> str:
        return f"{self.path}/{table}/gen={generation}"

    def read(self, table: str, schema: str, generations: list[int]) -> DataFrame:
        """Parts of a table, with the number of each."""
        schema = schema.format(id=self.id_type)
        if not generations:
            return self.spark.createDataFrame([], f"{schema}, gen int")
        paths = [self.part(table, g) for g in generations]
        return self.spark.read.schema(f"{schema}, gen int").option("basePath", f"{self.path}/{table}").parquet(*paths)

    def _all(self) -> list[int]:
        return list(range(self.generation + 1))

    def members(self) -> DataFrame:
        """``(row, id, key, sha, gen)`` of every live document."""
        members = self.read("members", MEMBERS, [g for g in self._all() if g not in self.deletions])
        if not self.deletions:
            return members
        gone = self.read("deleted", DELETED, list(self.deletions)).select(F.col("at").alias("gen"), "row")
        return members.join(gone, ["gen", "row"], "left_anti")

    def contents(self) -> DataFrame:
        """``(bucket, key, sha, text)`` of live texts, once or more, and of texts that have been deleted since."""
        return self.read("contents", CONTENTS, [g for g in self._all() if g not in self.deletions])

    def filters(self) -> DataFrame:
        return self.read("filters", FILTERS, [self.generation] if self.generation >= 0 else []).drop("gen")

    def bucket(self, key: str = "key") -> Column:
        return F.shiftrightunsigned(F.col(key), 64 - self.bits).cast("int") if self.bits else F.lit(0)


def create(spark: SparkSession, path: str, id_type: str = "bigint", bits: int | None = None) -> Index:
    """An empty index at a shared place that does not exist yet.

    ``bits``: there are two to the power of that many buckets; where it is not given, the first insertion
    chooses it by its number of rows.
    """
    return Index(spark, path, id_type, bits=-1 if bits is None else bits)


def open_index(spark: SparkSession, path: str, id_type: str = "bigint") -> Index:
    """The last state of an index that was written at ``path``."""
    state = spark.read.schema(f"{STATE}, gen int").parquet(f"{path}/state")
    last = state.orderBy(F.desc("gen")).first()
    return Index(spark, path, id_type, last.gen, last.bits, tuple(last.deletions))


def _commit(index: Index) -> Index:
    state = index.spark.createDataFrame([(index.bits, list(index.deletions))], STATE)
    state.coalesce(1).write.mode("overwrite").parquet(index.part("state", index.generation))
    return index


def _hits(index: Index, keys: DataFrame) -> DataFrame:
    """``(key)``: those that the filters may hold."""

    def probe(new, filters):
        import numpy as np
        import pyarrow as pa

        asked = new["key"].to_numpy()
        if not len(asked) or not filters.num_rows:
            return pa.table({"key": pa.array([], pa.int64())})
        return pa.table({"key": pa.array(asked[CuckooFilter.read(filters["slots"][0].as_py()).has(np.asarray(asked))], pa.int64())})

    by_bucket = keys.select(index.bucket().alias("bucket"), "key").groupBy("bucket")
    return by_bucket.cogroup(index.filters().groupBy("bucket")).applyInArrow(probe, "key bigint")


def _write_filters(old: Index, new: Index, changes: DataFrame, members: DataFrame) -> None:
    """The filters of ``new``: those of ``old`` with ``changes`` (``key``, ``added``), larger where they overflow."""
    out = f"{FILTERS}, full boolean"

    def update(changed, filters):
        import pyarrow as pa

        bucket = (changed["bucket"] if changed.num_rows else filters["bucket"])[0].as_py()
        added = changed["added"].to_numpy().astype(bool)
        keys = changed["key"].to_numpy()
        if filters.num_rows:
            held = CuckooFilter.read(filters["slots"][0].as_py())
            held.remove(keys[~added])
            full = not held.add(keys[added])
        else:
            held, full = CuckooFilter.of(keys[added]), False
        schema = pa.schema([("bucket", pa.int32()), ("slots", pa.binary()), ("full", pa.bool_())])
        return pa.table({"bucket": [bucket], "slots": [None if full else held.write()], "full": [full]}, schema)

    def rebuild(keys):
        import pyarrow as pa

        schema = pa.schema([("bucket", pa.int32()), ("slots", pa.binary())])
        made = CuckooFilter.of(keys["key"].to_numpy())
        return pa.table({"bucket": [keys["bucket"][0].as_py()], "slots": [made.write()]}, schema)

    by_bucket = changes.select(new.bucket().alias("bucket"), "key", "added").groupBy("bucket")
    updated = keep(by_bucket.cogroup(old.filters().groupBy("bucket")).applyInArrow(update, out), "filters")
    full = updated.filter("full").select("bucket")
    stored = members.select(new.bucket().alias("bucket"), "key").join(full, "bucket", "left_semi").distinct()
    larger = stored.groupBy("bucket").applyInArrow(rebuild, FILTERS)
    updated.filter("not full").select("bucket", "slots").unionByName(larger).write.mode("overwrite").parquet(new.part("filters", new.generation))


def _mark(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``marked``: true for all rows whose key is one of ``keys``, and for few others."""
    slot = F.pmod(F.col("key"), F.lit(MARK_BITS))
    place, position = F.floor(slot / _BITMAP_BITS).alias("__place"), F.pmod(slot, F.lit(_BITMAP_BITS))
    bitmaps = keys.groupBy(place).agg(F.bitmap_construct_agg(position).alias("__bitmap"))
    byte = F.substring("__bitmap", (F.floor(position / 8) + 1).cast("int"), F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(position, F.lit(8)).cast("int"))
    placed = rows.withColumn("__place", place).join(F.broadcast(bitmaps), "__place", "left")
    return placed.withColumn("marked", F.coalesce(bit == 1, F.lit(False))).drop("__place", "__bitmap")


def insert(
    index: Index, df: DataFrame, id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] | None = None
) -> tuple[Index, DataFrame]:
    """The index with every row of ``df``, and ``(id, keep_id, group_size, kept, text_sha256)`` of these rows.

    Texts are equal when they are the same after ``normalise`` (none: as they are); a null text counts as
    empty. A group is all live documents with equal texts, earlier ones too. Of a group the row with the
    largest id stays: ``keep_id`` is that id. Of several rows with that id, the last one to be inserted, or any one
    of those inserted together; exactly one row of a group is ``kept``. A null id is the smallest; a group of null
    ids only has a null ``keep_id``. Other columns are not returned. ``df`` is read three times and must give the
    same rows each time.
    """
    spark, change = index.spark, normalise or (lambda c: c)
    value = F.coalesce(change(F.col(text)), F.lit(""))
    texts = df.select(F.col(id).cast(index.id_type).alias("id"), value.alias("text")).withColumn("key", F.xxhash64("text"))
    generation = index.generation + 1
    sha = F.sha2("text", 256).alias("sha")
    texts.select(F.monotonically_increasing_id().alias("row"), "id", "key", sha).write.mode("overwrite").parquet(index.part("members", generation))
    bits = index.bits
    if bits < 0:
        rows = spark.read.parquet(index.part("members", generation)).count()
        bits = min(31, (rows // BUCKET_KEYS).bit_length())
        index = replace(index, bits=bits)
    new = replace(index, generation=generation)
    added = new.read("members", MEMBERS, [generation])
    counts = keep(added.groupBy("key").agg(F.count("*").alias("n")), "digests")
    again = counts.filter("n > 1").select("key")
    if index.generation >= 0:
        hits = keep(_hits(index, counts), "hits")
        suspects = keep(again.unionByName(hits).distinct(), "suspects")
    else:
        hits, suspects = None, again
    # Of the rows that are no hits each is a text of its own. The texts of the others are compared in full.
    marked = _mark(texts.select("key", "text"), suspects)
    compared = marked.filter("marked").select("key", "text").distinct()
    fresh = counts.select("key")
    if hits is not None:
        stored = _mark(index.contents(), hits).filter("marked").select("key", "text")
        live = _mark(index.members().select("key"), hits).filter("marked").select("key").distinct()
        compared = compared.join(stored.join(live, "key", "left_semi"), ["key", "text"], "left_anti")
        # A hit whose digest is not stored shares its sixteen bits with another, and is stored like any new one.
        fresh = fresh.join(live, "key", "left_anti")
    contents = marked.filter("not marked").select("key", "text").unionByName(compared)
    bucketed = contents.select(new.bucket().alias("bucket"), "key", sha, "text")
    bucketed.repartition("bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").parquet(new.part("contents", generation))
    written = new.read("contents", CONTENTS, [generation]).select("key", "sha")
    if not written.groupBy("key", "sha").count().filter("count > 1").isEmpty():
        raise ValueError("different texts have the same 64-bit digest and the same SHA-256")
    _write_filters(index, new, fresh.select("key", F.lit(True).alias("added")), new.members())
    new = _commit(new)
    return new, _groups(new, added, suspects, id)


def _groups(index: Index, rows: DataFrame, suspects: DataFrame, id: str) -> DataFrame:
    """``rows`` of members with their groups; keys that are no ``suspects`` have one row."""
    row = F.struct("id", "gen", "row")
    told = _mark(rows, suspects)
    live = _mark(index.members(), suspects).filter("marked")
    # Written, so that the rows of a large group can be split as a skewed key of the join with them.
    groups = keep(live.groupBy("key", "sha").agg(F.max(row).alias("last"), F.count("*").alias("group_size")), "groups")
    joined = told.filter("marked").join(groups, ["key", "sha"]).select(
        F.col("id").alias(id),
        F.col("last.id").alias("keep_id"),
        "group_size",
        ((F.col("last.gen") == F.col("gen")) & (F.col("last.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    alone = told.filter("not marked").select(
        F.col("id").alias(id), F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return alone.unionByName(joined)


def delete(index: Index, ids: DataFrame, id: str = "doc_id") -> Index:
    """The index without the live documents that ``ids`` names; ids it does not know and null ones change nothing.

    A digest leaves its filter with the last document that has it.
    """
    generation = index.generation + 1
    new = replace(index, generation=generation, deletions=(*index.deletions, generation))
    named = ids.select(F.col(id).cast(index.id_type).alias("id")).distinct()
    gone = keep(index.members().join(named, "id", "left_semi"), "gone")
    gone.select(F.col("gen").alias("at"), "row").write.mode("overwrite").parquet(new.part("deleted", generation))
    members = new.members()
    dead = gone.select("key").distinct().join(members.select("key").distinct(), "key", "left_anti")
    _write_filters(index, new, dead.select("key", F.lit(False).alias("added")), members)
    return _commit(new)


def live_groups(index: Index, id: str = "doc_id") -> DataFrame:
    """``insert``'s rows for every live document."""
    members = index.members()
    return _groups(index, members, members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), id)


def known(index: Index, df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, known)``: whether the index holds each row's text; nothing is changed."""
    value = F.coalesce(F.col(text), F.lit(""))
    rows = keep(df.select(F.col(id).alias("id"), value.alias("text"), F.xxhash64(value).alias("key")), "asked")
    hits = keep(_hits(index, rows.select("key").distinct()), "hits")
    live = index.members().select("key").distinct().join(hits, "key", "left_semi")
    stored = index.contents().join(live, "key", "left_semi").select("key", "text").distinct()
    told = _mark(rows, hits)
    seen = told.filter("marked").join(stored.withColumn("there", F.lit(True)), ["key", "text"], "left")
    return (
        told.filter("not marked").select(F.col("id").alias(id), F.lit(False).alias("known"))
        .unionByName(seen.select(F.col("id").alias(id), F.coalesce("there", F.lit(False)).alias("known")))
    )


def duplicates(
    df: DataFrame, path: str, id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] | None = None
) -> DataFrame:
    """``insert``'s rows, from a new index at ``path`` that holds all of ``df``."""
    empty = create(df.sparkSession, path, df.schema[id].dataType.simpleString())
    return insert(empty, df, id, text, normalise)[1]
