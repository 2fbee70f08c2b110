"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into ``max_bits // 2 + 1`` segments: of two that differ in
``max_bits`` bits or fewer, one segment then differs by at most one bit. Every
segment is indexed as it is and with each of its bits left out in turn. Two such
fingerprints meet under an equal key: the whole segment if it is the same, else
the one without the bit that differs, on opposite sides of it. What meets is
verified by counting the bits that differ.

Fingerprints are made distinct first, so copies never meet in pairs. Rows of a key
are read as a sorted stream; within a key only a spanning forest of the links is
written, never all of its pairs. A key that many fingerprints share is indexed once
more, by deletion variants of its open bits; what then still shares a key has so few
bits open that its neighbours are looked up, flip by flip.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm.components import components
from glossmill.sources.workspace import keep

SEED = 42
BITS = 64
#: Shingles hashed at a time; bounds memory, not the text.
BLOCK = 1 << 16
#: Fingerprints of one key that are compared one with the others; those of larger keys are indexed once more.
KEY_ROWS = 4_096

_FOUND = "hot boolean, variant int, masked bigint, a bigint, b bigint"


def simhash(text: str | None, shingle: int) -> int:
    """The unsigned fingerprint of one text."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, BLOCK):
        block = words[start : start + BLOCK + shingle - 1]
        if len(block) < shingle:
            block = [b" ".join(block)]
            grams = zip(block)
        else:
            grams = zip(*(block[i:] for i in range(shingle)))
        hashes = np.array([digest(b" ".join(g), SEED) for g in grams], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of a whole text, as a signed 64-bit integer.

    ASCII capitals are lowered and words are split at ASCII white space. A text
    shorter than a shingle is one shingle; one without words, or null, gives 0.
    """

    @F.arrow_udf("bigint")
    def fingerprints(texts):
        import numpy as np
        import pyarrow as pa

        return pa.array(np.array([simhash(t, shingle) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return fingerprints(text)


def fingerprint_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


@dataclass(frozen=True)
class Variant:
    """A way to index fingerprints: those that agree in ``mask`` meet, and may link across all bits of ``wild``."""

    mask: int
    wild: int = 0

    def within(self, max_bits: int) -> list[Variant]:
        """The variants of what this one leaves open: its free bits, cut into parts that are indexed likewise.

        A wildcard's bit is known to differ, and is no part of them.
        """
        free = [b for b in range(BITS) if not (self.mask | self.wild) >> b & 1]
        parts = (max_bits - self.wild.bit_count()) // 2 + 1
        edges = [len(free) * i // parts for i in range(parts + 1)]
        out = []
        for low, high in zip(edges, edges[1:]):
            segment = sum(1 << b for b in free[low:high])
            out.append(Variant(self.mask | segment, self.wild))
            out += [Variant(self.mask | segment & ~(1 << b), self.wild | 1 << b) for b in free[low:high]]
        return out


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _index(prints: DataFrame, value: str, variants: list[Variant]) -> DataFrame:
    """``(variant, masked, a)``: every fingerprint under each of the variants, which are known by their number."""
    masks = F.array(*(F.lit(_signed(v.mask)).cast("bigint") for v in variants))
    each = prints.select(F.col(value).alias("a"), F.posexplode(masks).alias("variant", "mask"))
    return each.select("variant", F.col("a").bitwiseAND(F.col("mask")).alias("masked"), "a")


def forest(values, wild: int, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints of one key, which differ in all bits of ``wild``.

    Each step compares one fingerprint with those not reached yet.
    """
    import numpy as np

    left, out, wild = np.arange(len(values)), [], np.uint64(wild)
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            differ = values[left] ^ values[at]
            near = (np.bitwise_count(differ) <= max_bits) & (differ & wild == wild)
            found, left = left[near], left[~near]
            out += [(int(values[at]), int(values[i])) for i in found]
            todo += found.tolist()
    return out


def neighbours(values, mask: int, wild: int, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what ``forest`` connects, by looking up what each fingerprint is after a few flips.

    For keys that hold many: their time grows with the flips that their free bits allow, not with their square.
    """
    import numpy as np

    values, out = np.unique(values), []
    label = np.arange(len(values))
    free = [b for b in range(BITS) if not (mask | wild) >> b & 1]
    spare = max_bits - wild.bit_count()
    for n in range(wild == 0, spare + 1):
        for bits in combinations(free, n):
            flipped = values ^ np.uint64(wild | sum(1 << b for b in bits))
            at = np.searchsorted(values, flipped).clip(max=len(values) - 1)
            one = np.flatnonzero((values[at] == flipped) & (label != label[at]))
            other = at[one]
            one, other = one[one < other], other[one < other]
            while len(one):
                # One link for each greater label: that many labels go, and no two links go round in a ring.
                high, low = np.maximum(label[one], label[other]), np.minimum(label[one], label[other])
                high, first = np.unique(high, return_index=True)
                out += zip(values[one[first]].tolist(), values[other[first]].tolist())
                parent = np.arange(len(values))
                parent[high] = low[first]
                while (parent[parent] != parent).any():
                    parent = parent[parent]
                label = parent[label]
                still = label[one] != label[other]
                one, other = one[still], other[still]
    return out


def _linker(variants: list[Variant], max_bits: int, key_rows: int, hand_on: bool) -> Callable:
    """Sorted rows of ``(variant, masked, fingerprint)`` to links and, with ``hand_on``, to the rows of keys with too many."""

    def link(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kind = pa.schema(
            [("hot", pa.bool_()), ("variant", pa.int32()), ("masked", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]
        )
        wilds = np.array([v.wild for v in variants], np.uint64)

        def rows(hot, variant, masked, a, b):
            n = len(a)
            full = lambda x, t: pa.array(np.broadcast_to(np.asarray(x, t), n))
            return pa.RecordBatch.from_arrays(
                [full(hot, bool), full(variant, np.int32), full(masked, np.int64), full(a, np.int64), full(b, np.int64)], schema=kind
            )

        def found(table: np.ndarray) -> Iterator:
            """Links within whole keys."""
            starts = np.flatnonzero(np.r_[True, (table[1:, 0] != table[:-1, 0]) | (table[1:, 1] != table[:-1, 1])])
            sizes, values = np.diff(np.r_[starts, len(table)]), table[:, 2].view(np.uint64)
            wild = wilds[table[starts, 0]]
            # A key whose rows are all alike in a bit that must differ holds no link.
            apart = np.bitwise_or.reduceat(values, starts) & ~np.bitwise_and.reduceat(values, starts)
            open_ = (sizes > 1) & (apart & wild == wild)
            two = starts[open_ & (sizes == 2)]
            if len(two):
                x, y = values[two], values[two + 1]
                good = np.bitwise_count(x ^ y) <= max_bits
                if good.any():
                    yield rows(False, 0, 0, x[good].view(np.int64), y[good].view(np.int64))
            for start, size in zip(starts[open_ & (sizes > 2)], sizes[open_ & (sizes > 2)]):
                part = table[start : start + size]
                variant = variants[part[0, 0]]
                if size > key_rows and hand_on:
                    yield rows(True, part[:, 0], part[:, 1], part[:, 2], 0)
                    continue
                held = part[:, 2].view(np.uint64)
                links = neighbours(held, variant.mask, variant.wild, max_bits) if size > key_rows else forest(held, variant.wild, max_bits)
                if links:
                    ends = np.array(links, np.uint64).view(np.int64)
                    yield rows(False, 0, 0, ends[:, 0], ends[:, 1])

        rest, hot = np.empty((0, 3), np.int64), None
        for batch in batches:
            table = np.column_stack([np.asarray(c).astype(np.int64) for c in batch.columns])
            if hot is not None:
                same = (table[:, 0] == hot[0]) & (table[:, 1] == hot[1])
                if same.any():
                    yield rows(True, *hot, table[same, 2], 0)
                    table = table[~same]
                if not len(table):
                    continue
                hot = None
            table = np.concatenate([rest, table])
            if not len(table):
                continue
            last = np.flatnonzero((table[:, 0] != table[-1, 0]) | (table[:, 1] != table[-1, 1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            rest, table = table[cut:], table[:cut]
            if len(table):
                yield from found(table)
            if len(rest) > key_rows and hand_on:
                hot = (int(rest[0, 0]), int(rest[0, 1]))
                yield rows(True, *hot, rest[:, 2], 0)
                rest = rest[:0]
        if len(rest):
            yield from found(rest)

    return link


def _linked(index: DataFrame, variants: list[Variant], max_bits: int, key_rows: int, hand_on: bool) -> DataFrame:
    dealt = index.repartition("variant", "masked").sortWithinPartitions("variant", "masked")
    return keep(dealt.mapInArrow(_linker(variants, max_bits, key_rows, hand_on), _FOUND), "links")


def links(prints: DataFrame, value: str = "fingerprint", max_bits: int = 3, key_rows: int = KEY_ROWS) -> DataFrame:
    """``(a, b)``: links that connect whatever differs in ``max_bits`` bits or fewer.

    ``prints`` holds each fingerprint once. Not every linked pair is listed, but
    every two linked fingerprints are connected by what is.
    """
    variants = Variant(0).within(max_bits)
    found = _linked(_index(prints, value, variants), variants, max_bits, key_rows, hand_on=True)
    out, hot = found.filter("not hot").select("a", "b"), found.filter("hot")
    if hot.isEmpty():
        return out
    # Keys whose rows are all alike in the bit that must differ hold no link. The others' rows are indexed again, by
    # the bits that are still open, which few rows can then share. The tables of variants have a fixed size.
    spark = prints.sparkSession
    wilds = spark.createDataFrame([(i, _signed(v.wild)) for i, v in enumerate(variants)], "variant int, wild bigint")
    apart = F.bit_or("a").bitwiseAND(F.bitwise_not(F.bit_and("a"))).alias("apart")
    keys = hot.groupBy("variant", "masked").agg(apart).join(F.broadcast(wilds), "variant")
    open_ = keys.filter(F.col("apart").bitwiseAND(F.col("wild")) == F.col("wild")).select("variant", "masked")
    inside = [(i, v) for i, outer in enumerate(variants) for v in outer.within(max_bits)]
    masks = spark.createDataFrame([(i, n, _signed(v.mask)) for n, (i, v) in enumerate(inside)], "variant int, inner int, mask bigint")
    again = hot.join(open_, ["variant", "masked"]).join(F.broadcast(masks), "variant")
    index = again.select(F.col("inner").alias("variant"), F.col("a").bitwiseAND(F.col("mask")).alias("masked"), "a")
    return out.unionByName(_linked(index, [v for _, v in inside], max_bits, key_rows, hand_on=False).select("a", "b"))


def _components_of(df: DataFrame, id: str, text: str, shingle: int, max_bits: int, key_rows: int) -> tuple[DataFrame, DataFrame]:
    """``(id, fingerprint)`` of every row, and ``(fingerprint, root, component_id)`` of every fingerprint."""
    prints = keep(df.select(F.col(id).alias(id), fingerprint(F.col(text), shingle).alias("fingerprint")), "prints")
    distinct = prints.groupBy("fingerprint").agg(F.min(id).alias("least"))
    linked = components(links(distinct, "fingerprint", max_bits, key_rows), "a", "b")
    members = keep(linked.join(distinct, linked["node"] == distinct["fingerprint"]).select("fingerprint", "root", "least"), "members")
    least = keep(members.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    in_group = members.select("fingerprint", "root").join(least, "root")
    of_print = distinct.join(in_group, "fingerprint", "left").select(
        "fingerprint",
        F.coalesce("root", "fingerprint").alias("root"),
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
    )
    # Written, so that a fingerprint that many rows share can be split as a skewed key of the join with them.
    return prints, keep(of_print, "components")


def near_duplicates(
    df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3, key_rows: int = KEY_ROWS
) -> DataFrame:
    """``(id, fingerprint, component_id)``, one row for each row of ``df``.

    ``fingerprint`` is a signed integer (``fingerprint_hex`` prints it). Texts link
    when theirs differ in ``max_bits`` bits or fewer, and ``component_id`` is the
    least id that links lead to, the row's own included. Repeated rows share a
    component; a null id is never the least, and a component of null ids only has
    a null ``component_id``. Other columns of ``df`` are not returned.

    Only fingerprints are shuffled: counted by value before, joined by value after,
    where the values of large groups of copies are split as skewed keys.
    """
    prints, of_print = _components_of(df, id, text, shingle, max_bits, key_rows)
    return prints.join(of_print.drop("root"), "fingerprint").select(id, "fingerprint", "component_id")


def keep_one(
    df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3, key_rows: int = KEY_ROWS
) -> DataFrame:
    """The rows of ``df``, one of each component: that with the least id.

    Of several rows with that id, and of the rows of a component of null ids only,
    the least in the order of the columns stays (no map column, then).
    """
    prints, of_print = _components_of(df, id, text, shingle, max_bits, key_rows)
    found = prints.join(of_print, "fingerprint")
    first = found.filter(F.col(id) == F.col("component_id")).groupBy(F.col(id).alias("__id")).agg(F.count("*").alias("__rows"))
    kept = df.join(first, df[id] == first["__id"]).drop("__id")
    out = kept.filter("__rows = 1").drop("__rows")
    row = F.min(F.struct(*df.columns)).alias("row")
    if not first.filter("__rows > 1").isEmpty():
        out = out.unionByName(kept.filter("__rows > 1").groupBy(id).agg(row).select("row.*"))
    if not found.filter(F.col(id).isNull() & F.col("component_id").isNull()).isEmpty():
        nulls = df.filter(F.col(id).isNull()).withColumn("__print", fingerprint(F.col(text), shingle))
        roots = of_print.filter(F.col("component_id").isNull()).select(F.col("fingerprint").alias("__print"), F.col("root").alias("__root"))
        out = out.unionByName(nulls.join(roots, "__print").groupBy("__root").agg(row).select("row.*"))
    return out
