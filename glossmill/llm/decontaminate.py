"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet on seeds, windows of ``MIN_MATCH`` words. For each
pair that shares seeds enough, the longest common run of words not yet marked is
found by Karp-Rabin fingerprints of windows, verified and marked as a tile, again and
again until none of ``MIN_MATCH`` words is left. The tiles may stand in any order, so a
passage whose sentences were moved about is still covered; an item counts as leaked
when its tiles cover ``COVERAGE`` of its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm.words import folded_words
from glossmill.sources.workspace import keep

MIN_MATCH = 5
COVERAGE = 0.5
#: Words of items in one broadcast; a larger benchmark takes more of them.
PART_WORDS = 1_000_000
#: A seed of more items than this is common.
COMMON = 64

_BASE = 0x9E3779B97F4A7C15
_FOUND = "array<struct<item:bigint,coverage:double,n_tiles:int,matched_words:int,longest:int>>"


_powers: list = []


def _powers_up_to(n: int):
    """Powers of the base modulo 2**64 and of its inverse, ``n`` at least; kept, and made longer by doubling."""
    import numpy as np

    if not _powers or len(_powers[0]) < n:
        size = 1 << max(10, n.bit_length())
        _powers[:] = [
            np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
            for b in (_BASE, pow(_BASE, -1, 1 << 64))
        ]
    return _powers


class Rolling:
    """Karp-Rabin fingerprints of all windows of a sequence, for any length of window."""

    def __init__(self, ids):
        import numpy as np

        self.n = len(ids)
        power, self.inverse = _powers_up_to(self.n)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(ids.astype(np.uint64) * power[: self.n], out=self.sums[1:])

    def windows(self, size: int):
        last = self.n - size + 1
        return (self.sums[size : size + last] - self.sums[:last]) * self.inverse[:last] if last > 0 else self.sums[:0]


def tiles(item, text, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two arrays of word numbers: ``(place in item, place in text, words)``.

    Numbers below 1 match nothing. Of tiles of one length the first in the item
    comes first, at its first free place in the text.
    """
    import numpy as np

    free = [item > 0, text > 0]
    rolling = Rolling(item), Rolling(text)
    out: list[tuple[int, int, int]] = []

    def open_windows(side: int, size: int):
        """Windows without a marked word: their places and fingerprints."""
        marked = np.concatenate([[0], np.cumsum(~free[side])])
        places = np.flatnonzero(marked[size:] == marked[:-size]) if size < len(marked) else np.zeros(0, np.int64)
        return places, rolling[side].windows(size)[places]

    def shared(size: int) -> bool:
        return bool(np.isin(open_windows(0, size)[1], open_windows(1, size)[1]).any())

    longest = min(len(item), len(text))
    while longest >= least and shared(least):
        low, high = least, longest
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if shared(middle) else (low, middle - 1)
        (mine, my_prints), (theirs, their_prints) = open_windows(0, low), open_windows(1, low)
        where: dict[int, list[int]] = {}
        for print_, place in zip(their_prints[np.isin(their_prints, my_prints)].tolist(), theirs[np.isin(their_prints, my_prints)].tolist()):
            where.setdefault(print_, []).append(place)
        marked = False
        for print_, place in zip(my_prints.tolist(), mine.tolist()):
            if not free[0][place : place + low].all():
                continue
            for other in where.get(print_, ()):
                if free[1][other : other + low].all() and (item[place : place + low] == text[other : other + low]).all():
                    free[0][place : place + low] = free[1][other : other + low] = False
                    out.append((place, other, low))
                    marked = True
                    break
        # Without a mark all matches of this length were chance collisions.
        longest = low if marked else low - 1
    return sorted(out)


@dataclass(frozen=True)
class Part:
    """Items of a benchmark, as every task gets them."""

    items: tuple[tuple[int, tuple[str, ...]], ...]
    min_match: int
    coverage: float = COVERAGE


class Index:
    """Seeds of the items of one part."""

    def __init__(self, part: Part):
        import numpy as np

        self.part, self.min_match = part, part.min_match
        self.number: dict[str, int] = {}
        self.items = []
        owners: dict[int, dict[int, list[int]]] = {}
        for at, (_, words) in enumerate(part.items):
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int64)
            size = min(self.min_match, len(ids))
            self.items.append((ids, size))
            if size:
                for place, print_ in enumerate(Rolling(ids).windows(size).tolist()):
                    owners.setdefault(print_, {}).setdefault(at, []).append(place)
        self.owners = owners
        # Seeds that many items have, an opening as a rule, do not lead to an item by themselves, unless it could be
        # leaked without any other.
        common = [print_ for print_, own in owners.items() if len(own) > COMMON]
        covered: dict[int, np.ndarray] = {}
        for print_ in common:
            for at, places in owners[print_].items():
                ids, size = self.items[at]
                reach = covered.setdefault(at, np.zeros(len(ids), bool))
                for place in places:
                    reach[place : place + size] = True
        self.by_common = {at for at, reach in covered.items() if reach.sum() >= part.coverage * len(reach)}
        self.leading = {print_: [at for at in owners[print_] if at in self.by_common] for print_ in common}
        self.sizes = sorted({size for _, size in self.items if size})
        self.seeds = np.array(sorted(owners), np.uint64)

    def search(self, text: str | None, coverage: float) -> Iterator[tuple]:
        """``(item, coverage, tiles, words matched, longest)`` of the items that a text leaks."""
        import numpy as np

        number = self.number.get
        ids = np.array([number(w, 0) for w in folded_words(text)], np.int64)
        if not len(ids) or not len(self.seeds):
            return
        rolling, unknown = None, np.zeros(len(ids) + 1, np.int64)
        np.cumsum(ids == 0, out=unknown[1:])
        hits: dict[int, list[tuple[int, int, int]]] = {}
        shared_by_many: list[tuple[int, int, int]] = []
        for size in self.sizes:
            if size > len(ids):
                break
            places = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(places):
                continue
            rolling = rolling or Rolling(ids)
            prints = rolling.windows(size)[places]
            nearest = np.minimum(np.searchsorted(self.seeds, prints), len(self.seeds) - 1)
            seen = self.seeds[nearest] == prints
            for place, print_ in zip(places[seen].tolist(), prints[seen].tolist()):
                own = self.leading.get(print_)
                if own is None:
                    own = self.owners[print_]
                else:
                    shared_by_many.append((place, print_, size))
                for at in own:
                    if self.items[at][1] == size:
                        hits.setdefault(at, []).append((place, print_, size))
        for at, found in hits.items():
            if at not in self.by_common:
                found += [hit for hit in shared_by_many if hit[2] == self.items[at][1] and at in self.owners[hit[1]]]
        for at, found in sorted(hits.items()):
            item, least = self.items[at]
            # No tile reaches beyond the seeds, on either side.
            reach, part = np.zeros(len(item), bool), np.zeros(len(ids) + 1, bool)
            for place, print_, size in found:
                part[place : place + size] = True
                for start in self.owners[print_][at]:
                    reach[start : start + size] = True
            if reach.sum() < coverage * len(item):
                continue
            # Each stretch of the text that seeds cover, with a gap that matches nothing after it.
            keep = part.copy()
            keep[1:] |= part[:-1]
            padded = np.append(ids, 0)
            padded[~part] = 0
            found_tiles = tiles(item, padded[keep], least)
            matched = sum(t[2] for t in found_tiles)
            if found_tiles and matched >= coverage * len(item):
                yield at, matched / len(item), len(found_tiles), matched, max(t[2] for t in found_tiles)


_indexes: list[Index] = []


def _index(shared) -> Index:
    """Built once in each worker; the index holds its part, so that no other is taken for it."""
    part = shared.value
    if not _indexes or _indexes[0].part is not part:
        _indexes[:] = [Index(part)]
    return _indexes[0]


def parts(
    benchmark: DataFrame, id: str = "item_id", text: str = "text", min_match: int = MIN_MATCH, part_words: int = PART_WORDS, coverage: float = COVERAGE
) -> Iterator[Part]:
    """A benchmark in parts of about ``part_words`` words, each gathered once its size is known.

    Items without words are left out; null ids count as ids of their own.
    """
    size = F.size(F.split(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}\p{M}\p{N}]+"))
    rows = benchmark.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"), size.alias("size")).filter("text is not null").distinct()
    total = rows.agg(F.sum("size")).first()[0] or 0
    n = total // part_words + 1
    for i in range(n):
        chosen = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == i)
        items = sorted(((r["id"], tuple(folded_words(r["text"]))) for r in chosen.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield Part(tuple(x for x in items if x[1]), min_match, coverage)


def _search(shared, coverage: float) -> Callable[[Column], Column]:
    """The leaks of a part that every task gets."""

    @F.arrow_udf(_FOUND)
    def search(texts):
        import pyarrow as pa

        own, names = _index(shared), [i for i, _ in shared.value.items]
        kind = pa.struct(
            [("item", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()), ("matched_words", pa.int32()), ("longest", pa.int32())]
        )
        out = [
            [{"item": names[at], "coverage": c, "n_tiles": n, "matched_words": m, "longest": x} for at, c, n, m, x in own.search(t, coverage)]
            for t in texts.to_pylist()
        ]
        return pa.array(out, pa.list_(kind))

    return search.asNondeterministic()


def leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
    part_words: int = PART_WORDS,
    out: str = "leaks",
) -> DataFrame:
    """Add the benchmark items that each whole text leaks: an array of ``(item, coverage, n_tiles, matched_words, longest)``.

    Words are compared without regard to case and without punctuation, in any script. An item shorter than
    ``min_match`` words must occur as a whole. Repeated items with one id and text
    count once; a null or empty text leaks nothing; a column named ``out`` is
    replaced, the others pass. A benchmark of up to ``part_words`` words is broadcast as it is. A longer one is
    taken in parts of about that size, one after the other: each part's leaks are written, and its broadcast ends,
    before the next is gathered. Documents are then written once, and joined with what was found.
    """
    rest = documents.drop(out)
    spark, made = documents.sparkSession, parts(benchmark, item_id, item_text, min_match, part_words, coverage)
    first, second = next(made, None), next(made, None)
    if second is None:
        if first is None or not first.items:
            return rest.withColumn(out, F.array().cast(_FOUND))
        return rest.withColumn(out, _search(spark.sparkContext.broadcast(first), coverage)(F.col(text)))
    numbered = keep(rest.withColumn("__row", F.monotonically_increasing_id()), "documents")
    found = []
    for part in chain((first, second), made):
        if part.items:
            shared = spark.sparkContext.broadcast(part)
            leaked = numbered.select("__row", _search(shared, coverage)(F.col(text)).alias(out))
            found.append(keep(leaked.filter(F.size(out) > 0), "leaks"))
            shared.destroy()
    if not found:
        return numbered.withColumn(out, F.array().cast(_FOUND)).drop("__row")
    # Few documents leak; each has as many leaks as it holds items.
    merged = reduce(DataFrame.unionByName, found).groupBy("__row").agg(F.sort_array(F.flatten(F.collect_list(out))).alias("__leaks"))
    joined = numbered.join(merged, "__row", "left")
    return joined.select(*(F.col(c) for c in rest.columns), F.coalesce("__leaks", F.array().cast(_FOUND)).alias(out))


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``documents`` that leak no item."""
    return leaks(documents, benchmark, text, out="__leaks", **options).filter(F.size("__leaks") == 0).drop("__leaks")
