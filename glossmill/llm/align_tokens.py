"""Cross-tokenizer alignment by whitespace-token anchors.

Every text is tokenised in full by both vocabularies, and the tokens' bytes are laid
side by side. Where tokens of both end at the same byte and both next tokens begin
with a space, the text is cut: such an anchor is verified by the byte offsets, not
assumed. Between two anchors lie a few token ids of either side, a word as a rule, and
the same words come again and again: a window is aligned once and remembered by its
two tuples of ids. A text's alignment is that of its windows, one after the other.

Which id pairs are linked how often in the whole corpus is counted by document.
Every document keeps its distinct links, so the counts are found for it without
aligning again: those of the most frequent pairs, as many as ``HEAD_PAIRS``, are sent
to every task, those of all others come by a join.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, lru_cache
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.sources.workspace import keep

#: Windows that a worker remembers, of so many tokens at most. When the memory is full, those stay that were met again.
REMEMBERED, REMEMBERED_TOKENS = 100_000, 48
#: Text bytes that a worker tokenises at a time; one longer text is tokenised alone.
BUFFER_BYTES = 1 << 19
#: Pairs whose counts are sent to every task: 16 bytes each.
HEAD_PAIRS = 1 << 19

# Letters, digits and signs that every Unicode version of the last years classes alike.
_SETTLED = re.compile("[\x00-ԯ -⁣€™　-〩ぁ-ゖァ-ヺ一-龥가-힣！-～]*")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Longer texts are left to the vocabulary's own library: their white space could overflow the other one's stack.
_FAST_CHARS = 100_000
_ALIGNED = (
    "struct<n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups:string,a:array<int>,b:array<int>,times:array<int>>"
)


def _byte_of_sign() -> dict[str, int]:
    """The bytes behind the signs of a byte-level vocabulary: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return {chr(b if b in plain else next(others)): b for b in range(256)}


class ByteLevel:
    """A byte-level BPE vocabulary, a JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        sign, vocab = _byte_of_sign(), spec["model"]["vocab"]
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        of_id = {i: bytes(sign[c] for c in token) for token, i in vocab.items() if i not in added} | added
        self.path, self.tokens = path, [of_id.get(i, b"") for i in range(max(of_id) + 1)]
        self.fast = self._ranked(spec, of_id, added)

    @cached_property
    def library(self) -> Any:
        """The vocabulary's own library, for texts that the ranks are not trusted with."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.no_truncation()
        made.no_padding()
        made.encode_special_tokens = True
        return made

    def _ranked(self, spec: dict, of_id: dict[int, bytes], added: dict) -> Any:
        """The same vocabulary by ranks, where ids are in the order of the merges; several times as fast."""
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        single = all(len(of_id[i]) == 1 for i in range(256)) if len(of_id) > 256 else False
        plain = not (model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or spec["normalizer"])
        if not (plain and single and made == list(range(256, 256 + len(made))) and before.get("type") == "ByteLevel"):
            return None
        if before.get("add_prefix_space") or not before.get("use_regex", True):
            return None
        import tiktoken

        ranks = {token: i for i, token in of_id.items() if i not in added}
        return tiktoken.Encoding("ranked", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[Any]:
        """The ids of each text, as arrays of 32-bit integers."""
        import numpy as np

        out: list[Any] = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if self.fast and len(text) <= _FAST_CHARS and (text.isascii() or _SETTLED.fullmatch(text)):
                out[i] = np.array(self.fast(text), np.int32)
            else:
                rest.append(i)
        for i, found in zip(rest, self.library.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False) if rest else ()):
            out[i] = np.array(found.ids, np.int32)
        return out


class Pieces:
    """A sentence-piece vocabulary, a model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.tokens = [
            bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


def _laid(first: Any, sizes: Any) -> Any:
    """The places of stretches, one stretch after the other."""
    import numpy as np

    return np.arange(sizes.sum()) + np.repeat(first - (sizes.cumsum() - sizes), sizes)


@dataclass
class Windows:
    """Windows with their alignments, as columns: where each has its ids and links in what is laid end to end."""

    keys: Any
    starts: tuple[Any, Any]
    sizes: tuple[Any, Any]
    ids: tuple[Any, Any]
    groups: Any
    n_groups: Any
    link_starts: Any
    n_links: Any
    links: Any

    @classmethod
    def none(cls) -> Windows:
        import numpy as np

        whole, token = np.zeros(0, np.int64), np.zeros(0, np.int32)
        return cls(np.zeros(0, np.uint64), (whole, whole), (whole, whole), (token, token), np.zeros(0, object), whole, whole, whole, whole)

    def some(self, at: Any) -> Windows:
        """Those at some places, laid out anew."""
        sizes = tuple(x[at] for x in self.sizes)
        ids = tuple(x[_laid(first[at], n)] for x, first, n in zip(self.ids, self.starts, sizes))
        n_links = self.n_links[at]
        links = self.links[_laid(self.link_starts[at], n_links)]
        starts = tuple(n.cumsum() - n for n in sizes)
        return Windows(self.keys[at], starts, sizes, ids, self.groups[at], self.n_groups[at], n_links.cumsum() - n_links, n_links, links)

    def and_(self, other: Windows) -> Windows:
        import numpy as np

        def both(one: Any, two: Any, more: int = 0) -> Any:
            return np.concatenate([one, two + more if more else two])

        return Windows(
            both(self.keys, other.keys),
            tuple(both(x, y, len(ids)) for x, y, ids in zip(self.starts, other.starts, self.ids)),
            tuple(map(both, self.sizes, other.sizes)),
            tuple(map(both, self.ids, other.ids)),
            both(self.groups, other.groups),
            both(self.n_groups, other.n_groups),
            both(self.link_starts, other.link_starts, len(self.links)),
            both(self.n_links, other.n_links),
            both(self.links, other.links),
        )


class Aligner:
    """Two vocabularies, with the windows a worker has aligned of late."""

    def __init__(self, path_a: str, path_b: str):
        import numpy as np

        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        lengths = [[len(t) for t in side.tokens] for side in (self.a, self.b)]
        # An id with what may follow it: another of its side, the other side, the next group, the next window.
        self.parts = [part for i in range(max(map(len, lengths))) for part in (f"{i},", f"{i}|", f"{i};", f"{i}")]
        self.sizes = [np.array(x, np.int64) for x in lengths]
        self.spaced = [np.array([t[:1] == b" " for t in side.tokens]) for side in (self.a, self.b)]
        #: Remembered windows by key, in order, and whether each was met since the memory was last full.
        self.known, self.met = Windows.none(), np.zeros(0, bool)

    def _align(self, keys: Any, starts: tuple, sizes: tuple, ids: tuple, ends: tuple) -> Windows:
        """Groups and links of windows, which stand in the order of their places."""
        import numpy as np

        (a, b), (ends_a, ends_b) = ([x[_laid(first, n)] for x, first, n in zip(side, starts, sizes)] for side in (ids, ends))
        last = ends_b.searchsorted(ends_a)
        closes_a, closes_b = ends_b[last] == ends_a, ends_a[ends_a.searchsorted(ends_b)] == ends_b
        # Every token of one side overlaps the other's from the first that ends behind its start to the last that begins before its end.
        first = ends_b.searchsorted(ends_a - self.sizes[0][a], "right")
        often = last - first + 1
        links = np.repeat(a.astype(np.int64), often) | b[_laid(first, often)].astype(np.int64) << 32
        own = tuple(n.cumsum() - n for n in sizes)
        n_links = np.add.reduceat(often, own[0])
        # A group's tokens of one side, then of the other; what follows a token depends on whether it is the last of either.
        ends_window = np.zeros(len(b), bool)
        ends_window[sizes[1].cumsum() - 1] = True
        signs = np.concatenate([4 * a + closes_a, 4 * b + 2 * closes_b + ends_window])
        group = np.concatenate([2 * (closes_a.cumsum() - closes_a), 2 * (closes_b.cumsum() - closes_b) + 1])
        parts = list(map(self.parts.__getitem__, signs[group.argsort(kind="stable")].tolist()))
        bounds = [0, *(sizes[0] + sizes[1]).cumsum().tolist()]
        groups = np.empty(len(keys), object)
        groups[:] = ["".join(parts[i:j]) for i, j in zip(bounds, bounds[1:])]
        n_groups = np.add.reduceat(closes_a.astype(np.int64), own[0])
        return Windows(keys, own, sizes, (a, b), groups, n_groups, n_links.cumsum() - n_links, n_links, links)

    def _recall(self, keys: Any, starts: tuple, sizes: tuple, ids: tuple) -> Any:
        """Which remembered window each one is; -1 where none is. A key may be that of another: the ids decide."""
        import numpy as np

        known = self.known
        if not len(known.keys):
            return np.full(len(keys), -1)
        at = known.keys.searchsorted(keys).clip(max=len(known.keys) - 1)
        same = known.keys[at] == keys
        for side in (0, 1):
            same &= known.sizes[side][at] == sizes[side]
        here = same.nonzero()[0]
        for side in (0, 1):
            if len(here):
                n = sizes[side][here]
                differ = ids[side][_laid(starts[side][here], n)] != known.ids[side][_laid(known.starts[side][at[here]], n)]
                here = here[~np.bitwise_or.reduceat(differ, n.cumsum() - n)]
        found = np.full(len(keys), -1)
        found[here] = at[here]
        self.met[at[here]] = True
        return found

    def _remember(self, new: Windows) -> None:
        import numpy as np

        new = new.some((new.sizes[0] + new.sizes[1] <= REMEMBERED_TOKENS).nonzero()[0])
        if len(self.known.keys) + len(new.keys) > REMEMBERED:
            self.known = self.known.some(self.met.nonzero()[0][: REMEMBERED // 2])
            self.met = np.zeros(len(self.known.keys), bool)
        both, met = self.known.and_(new), np.append(self.met, np.zeros(len(new.keys), bool))
        # Of windows with one key the first is remembered.
        _, first = np.unique(both.keys, return_index=True)
        self.known, self.met = both.some(first[:REMEMBERED]), met[first[:REMEMBERED]]

    def align(self, ids: tuple, docs: Any) -> tuple[Any, Any, Windows]:
        """Windows of texts laid end to end: where each text's begin, of which kind each one is, and the kinds.

        ``docs`` is where in the first side's ids the texts end. Both sides have the same bytes.
        """
        import numpy as np

        ends = tuple(sizes[side].cumsum() for sizes, side in zip(self.sizes, ids))
        at_a = np.append(self.spaced[0][ids[0][1:]].nonzero()[0], len(ids[0]) - 1)
        at_b = ends[1].searchsorted(ends[0][at_a])
        shared = (ends[1][at_b] == ends[0][at_a]) & np.append(self.spaced[1][ids[1][1:]], True)[at_b]
        cuts = at_a[shared] + 1, at_b[shared] + 1
        starts = tuple(np.append(0, x[:-1]) for x in cuts)
        sizes = tuple(x - y for x, y in zip(cuts, starts))
        keys, ranks = np.zeros(len(starts[0]), np.uint64), []
        for side, first, n in zip(ids, starts, sizes):
            ranks.append(np.arange(len(side)) - np.repeat(first, n))
            mixed = (side.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (ranks[-1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            keys = keys * np.uint64(31) ^ np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), first)
        some, first, kind = np.unique(keys, return_index=True, return_inverse=True)
        # Keys may be equal by chance: a window that has other ids than the first one with its key is of its own kind.
        model = first[kind]
        other = (sizes[0] != sizes[0][model]) | (sizes[1] != sizes[1][model])
        for side, begin, n, rank in zip(ids, starts, sizes, ranks):
            there = np.minimum(np.repeat(begin[model], n) + rank, len(side) - 1)
            other |= np.bitwise_or.reduceat(side != side[there], begin)
        lone = other.nonzero()[0]
        kind[lone] = len(first) + np.arange(len(lone))
        first = np.append(first, lone)
        starts, sizes = tuple(x[first] for x in starts), tuple(x[first] for x in sizes)
        found = self._recall(keys[first], starts, sizes, ids)
        new = (found < 0).nonzero()[0]
        new = new[starts[0][new].argsort()]
        kinds = self.known
        if len(new):
            aligned = self._align(keys[first][new], tuple(x[new] for x in starts), tuple(x[new] for x in sizes), ids, ends)
            found[new] = len(kinds.keys) + np.arange(len(new))
            kinds = kinds.and_(aligned)
            self._remember(aligned)
        return starts_of_texts(cuts[0], docs), found[kind], kinds

    def batch(self, texts: list[str | None]):
        """Alignments of a few texts, as an Arrow column."""
        import numpy as np
        import pyarrow as pa

        spaced = [" " + (t or "") for t in texts]
        ids_a, ids_b = self.a.encode(spaced), self.b.encode([t or "" for t in texts])
        tokens, kept = self.b.tokens, []
        for i, text in enumerate(spaced):
            raw = text.encode()
            # A byte-level vocabulary gives back any text; by its length it shows that it is one.
            if len(raw) > 1 and int(self.sizes[0][ids_a[i]].sum()) == len(raw) and b"".join([tokens[j] for j in ids_b[i]]) == raw:
                kept.append(i)
        n_a, n_b, n_groups, n_links = (np.zeros(len(texts), np.int64) for _ in range(4))
        groups: list[str | None] = [None] * len(texts)
        none = np.zeros(0, np.int64)
        pairs, times = [none] * len(texts), [none] * len(texts)
        if kept:
            n_a[kept], n_b[kept] = [len(ids_a[i]) for i in kept], [len(ids_b[i]) for i in kept]
            sides = np.concatenate([ids_a[i] for i in kept]), np.concatenate([np.array(ids_b[i], np.int32) for i in kept])
            windows, kind, kinds = self.align(sides, n_a[kept].cumsum())
            for i, first, end in zip(kept, windows, windows[1:]):
                own = kind[first:end]
                groups[i] = ";".join(kinds.groups[own].tolist())
                n_groups[i], n_links[i] = kinds.n_groups[own].sum(), kinds.n_links[own].sum()
                pairs[i], times[i] = np.unique(kinds.links[_laid(kinds.link_starts[own], kinds.n_links[own])], return_counts=True)
        offsets = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
        found, often = np.concatenate([none, *pairs]), np.concatenate([none, *times])
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (found & 0xFFFFFFFF, found >> 32, often)]
        names = ["n_a", "n_b", "n_groups", "n_links", "groups", "a", "b", "times"]
        return pa.StructArray.from_arrays([*map(pa.array, (n_a, n_b, n_groups, n_links)), pa.array(groups, pa.string()), *lists], names)


def starts_of_texts(cuts: Any, docs: Any) -> Any:
    """Of every text the number of its first window, and at last that of all windows."""
    import numpy as np

    return np.append(0, np.searchsorted(cuts, docs) + 1)


@lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align(text: Column, path_a: str, path_b: str) -> Column:
    """The alignment of every whole text, a struct: counts, ``groups`` as text, and its distinct links.

    ``path_a`` names a byte-level vocabulary, which gets a space and the text, ``path_b`` a sentence-piece
    model, which puts the space there itself; every executor can open both. ``groups`` lists the ids between
    shared ends, ``a1,a2|b1;a3|b2,b3``. ``a``, ``b`` and ``times`` hold the distinct id pairs whose bytes
    overlap and how often each does. A null or empty text, or one that either vocabulary does not give back
    byte for byte, has no tokens: zeros, null ``groups``, no links.
    """

    @F.arrow_udf(_ALIGNED)
    def align_texts(texts):
        import pyarrow as pa

        # Nothing here refers to itself, and looking through all windows for what does takes time.
        gc.disable()
        own, out, batch, size = _aligner(path_a, path_b), [], [], 0
        for text in texts.to_pylist():
            batch.append(text)
            size += len(text or "")
            if size >= BUFFER_BYTES:
                out.append(own.batch(batch))
                batch, size = [], 0
        out.append(own.batch(batch))
        gc.enable()
        return pa.concat_arrays(out)

    return align_texts.asNondeterministic()(text)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(a, b, documents, best)``: by how many documents each pair is linked, and whether no pair of its ``a`` has more.

    Counted before the shuffle as well as after it, so a pair that most documents hold is one row for each task.
    """
    pairs = aligned.select(F.explode(F.arrays_zip("a", "b")).alias("pair")).select("pair.a", "pair.b")
    counted = keep(pairs.groupBy("a", "b").agg(F.count("*").alias("documents")), "pairs")
    most = counted.groupBy("a").agg(F.max("documents").alias("most"))
    return counted.join(most, "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))


def _level(documents: str) -> Column:
    """Numbers of documents in eight steps for each power of two."""
    return F.floor(F.log2(documents) * 8)


def _head(counts: DataFrame, limit: int) -> int:
    """The least level from which on the pairs are no more than ``limit``."""
    # A few hundred rows, however many pairs there are.
    sizes = counts.groupBy(_level("documents").alias("level")).agg(F.count("*").alias("pairs")).collect()
    taken, least = 0, 1 << 20
    for level, pairs in sorted(sizes, reverse=True):
        taken += pairs
        if taken > limit:
            break
        least = level
    return least if taken > limit else 0


def _known(head: Any) -> Any:
    """Sums over the links whose counts every task has, and the other links."""

    @F.arrow_udf("struct<best:bigint,total:bigint,rest:array<struct<a:int,b:int,times:int>>>")
    def known(a, b, times):
        import numpy as np
        import pyarrow as pa

        keys, documents, best = head.value
        offsets = a.offsets.to_numpy().astype(np.int64)
        part = lambda x: x.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        left, right, weight = part(a), part(b), part(times)
        offsets -= offsets[0]
        pairs = left << 32 | right
        at = np.searchsorted(keys, pairs).clip(max=max(len(keys) - 1, 0))
        found = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
        of = lambda values: np.add.reduceat(np.r_[values, 0], offsets[:-1]) * (np.diff(offsets) > 0)
        count = np.where(found, documents[at], 0) if len(keys) else np.zeros(len(pairs), np.int64)
        is_best = found & best[at] if len(keys) else found
        missing = ~found
        rest = pa.StructArray.from_arrays(
            [pa.array(x[missing].astype(np.int32)) for x in (left, right, weight)], ["a", "b", "times"]
        )
        ends = np.r_[0, np.cumsum(missing)][offsets]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)
        return pa.StructArray.from_arrays(
            [pa.array(of(weight * is_best), pa.int64()), pa.array(of(weight * count), pa.int64()), lists], ["best", "total", "rest"]
        )

    return known


def link_sums(aligned: DataFrame, counts: DataFrame, row: str, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum``; ``row`` names a column that tells its rows apart.

    Both sum over all links of a row, ``n_best`` those of best pairs, ``count_sum`` the pairs' documents.
    """
    import numpy as np

    spark = aligned.sparkSession
    least, level = _head(counts, head_pairs), _level("documents")
    top = counts.filter(level >= least).select(
        F.shiftleft(F.col("a").cast("bigint"), 32).bitwiseOR(F.col("b").cast("bigint")).alias("pair"), "documents", "best"
    )
    table = top.toArrow().sort_by("pair")
    # No more than ``head_pairs`` rows, whatever the corpus.
    head = spark.sparkContext.broadcast(
        (
            table["pair"].to_numpy().astype(np.int64),
            table["documents"].to_numpy().astype(np.int64),
            np.asarray(table["best"].to_pylist(), bool),
        )
    )
    summed = aligned.withColumn("__sums", _known(head).asNondeterministic()(F.col("a"), F.col("b"), F.col("times"))).drop("a", "b", "times")
    if not least:
        return summed.select(*[c for c in summed.columns if c != "__sums"], F.col("__sums.best").alias("n_best"), F.col("__sums.total").alias("count_sum"))
    summed = keep(summed, "sums")
    rare = summed.select(row, F.explode("__sums.rest").alias("link")).select(row, "link.*")
    joined = rare.join(counts.filter(level < least), ["a", "b"])
    more = joined.groupBy(row).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best"), F.sum(F.col("times") * F.col("documents")).alias("__total")
    )
    zero = F.lit(0).cast("bigint")
    return summed.join(more, row, "left").select(
        *[F.col(c) for c in summed.columns if c != "__sums"],
        (F.col("__sums.best") + F.coalesce("__best", zero)).alias("n_best"),
        (F.col("__sums.total") + F.coalesce("__total", zero)).alias("count_sum"),
    )


def alignments(
    df: DataFrame,
    path_a: str,
    path_b: str,
    id: str = "doc_id",
    text: str = "text",
    head_pairs: int = HEAD_PAIRS,
    groups: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum)``, one row for each row of ``df``.

    The columns are those of ``align`` and ``link_sums``. Repeated rows each count as a document, null ids too;
    other columns are not returned. Texts are aligned once, into a written table; the groups' text is twice as
    long as the text itself, and ``groups`` says what is to be kept of it if not all.
    """
    aligned = df.select(F.col(id).alias("__id"), align(F.col(text), path_a, path_b).alias("x")).select("__id", "x.*")
    if groups is not None:
        aligned = aligned.withColumn("groups", groups(F.col("groups")))
    aligned = keep(aligned.withColumn("__row", F.monotonically_increasing_id()), "aligned")
    summed = link_sums(aligned, keep(pair_counts(aligned), "counts"), "__row", head_pairs)
    return summed.select(F.col("__id").alias(id), *(c for c in summed.columns if not c.startswith("__")))
