r"""BPE encoding and decoding by tree concatenation.

A text that no task should encode alone is cut into leaves, the leaves are encoded
in parallel, and neighbours are joined pairwise. Where a cut falls on white space
the two sides agree as they are, because no merge crosses white space. Where it
falls inside an unsplit run (a very long word) a window of tokens around the join
is encoded again, and grows until its outermost tokens are the ones that both
sides had. A token sequence is the encoding of its text exactly when every two
neighbours are the encoding of theirs; the window brings that about at the join
and leaves it as it was elsewhere, so the result is exact.

The same tree encodes a long word inside one task, from leaves of ``LEAF_SYMBOLS``.

Between tasks and on disk ids are packed into as few bytes as hold the vocabulary's
largest one, and texts are decoded only in the rows that hold them.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.sources.workspace import keep

#: Texts of more code points than this are encoded by several tasks.
LEAF_CHARS = 16_384
#: Words of more symbols than this are encoded by halves.
LEAF_SYMBOLS = 48
#: Tokens taken from either side of a join at first.
WINDOW = 4
#: Words and runs that a worker remembers, of so many characters at most; both memories start anew when full.
REMEMBERED, REMEMBERED_CHARS = 100_000, 64

_NO_RANK = 1 << 60
# White space that separates runs: the Unicode property. str.split() also takes
# the four separators below, which are not in it.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{_SPACES}]")
_RUN = re.compile(f"[^{_SPACES}]+")
# The vocabulary's split pattern, and the same for a lower-case run of Latin-1.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER, _NUMBER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")

_LEAF_TYPE = "array<struct<leaf:int,open:boolean,text:string,pieces:array<binary>>>"


class Encoder:
    """One vocabulary, with what the worker has encoded so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path, tokenizer = path, Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError(f"{path}: only plain BPE vocabularies are supported")
        self.normalise, self.pre_tokenise = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        if [p for p, _ in self.pre_tokenise("a  b")] != ["a", "b"]:
            raise ValueError(f"{path}: the split pattern must drop white space")
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens must match their text as it stands")
        self.added = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        alphabet = {b: self.pre_tokenise(bytes([b]).decode())[0][0] for b in range(33, 127)}
        others = iter(range(256, 512))
        for b in range(256):
            if b not in alphabet:
                alphabet[b] = chr(b) if 161 <= b != 173 else chr(next(others))
        self.byte_sign = [alphabet[b] for b in range(256)]
        self.inner = [self.vocab[c] for c in self.byte_sign]
        self.final = [self.vocab[c + self.suffix] for c in self.byte_sign]
        self.short_word = tokenizer.model.tokenize
        sample = "".join(map(chr, range(256)))
        self.latin = _PATTERN in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\") and all(
            self.normalise(c) == c.lower() for c in sample if not _SPACE.match(c)
        )
        self.id_bytes = max(1, (max([*self.vocab.values(), *self.special.values()]).bit_length() + 7) // 8)
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @cached_property
    def merges(self) -> tuple[dict[tuple[int, int], int], list[int], dict[int, tuple[int, int]]]:
        """Ranks by pair, tokens by rank, pairs by token; only long words need them."""
        with open(self.path, encoding="utf-8") as file:
            pairs = json.load(file)["model"]["merges"]
        rank, made = {}, []
        for pair in pairs:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            rank[self.vocab[left], self.vocab[right]] = len(made)
            made.append(self.vocab[left + right])
        return rank, made, dict(zip(made, rank, strict=True))

    def symbols(self, token: int) -> list[int]:
        """What a token was merged from."""
        out, todo, parts = [], [token], self.merges[2]
        while todo:
            if pair := parts.get(token := todo.pop()):
                todo += pair[::-1]
            else:
                out.append(token)
        return out

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges, the lowest rank first and the leftmost of equals."""
        if len(symbols) > 4 * LEAF_SYMBOLS:
            return self._merge_long(symbols)
        rank, made, _ = self.merges
        ids, rank = list(symbols), rank.get
        ranks = [rank(pair, _NO_RANK) for pair in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) != _NO_RANK:
            at = ranks.index(least)
            ids[at : at + 2] = [made[least]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((ids[at - 1], ids[at]), _NO_RANK)
            if at < len(ranks):
                ranks[at] = rank((ids[at], ids[at + 1]), _NO_RANK)
        return ids

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same in n log n steps, for windows that have grown long."""
        rank, made, _ = self.merges
        ids, n = list(symbols), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(rank[pair], i, pair) for i, pair in enumerate(zip(ids, ids[1:])) if pair in rank]
        heapq.heapify(queue)
        while queue:
            least, at, pair = heapq.heappop(queue)
            right = after[at]
            if right >= n or (ids[at], ids[right]) != pair:
                continue
            ids[at], ids[right] = made[least], -1
            after[at] = after[right]
            if after[at] < n:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] < n and (pair := (ids[left], ids[after[left]])) in rank:
                    heapq.heappush(queue, (rank[pair], left, pair))
        return [i for i in ids if i >= 0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring texts, from their encodings."""
        if not left or not right:
            return left + right
        size = WINDOW
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            window = self.merge([s for token in left[a:] + right[:b] for s in self.symbols(token)])
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:a] + window + right[b:]
            size *= 2

    def tree(self, symbols: list[int]) -> list[int]:
        """Encode by halves."""
        if len(symbols) <= LEAF_SYMBOLS:
            return self.merge(symbols)
        half = len(symbols) // 2
        return self.join(self.tree(symbols[:half]), self.tree(symbols[half:]))

    def split(self, run: str) -> list[list[int]]:
        """The symbols of each word of a run; an added token is a word."""
        out, at = [], 0
        for hit in [*self.added.finditer(run), None]:
            part = self.normalise(run[at : hit.start() if hit else None]) if self.added.pattern else run
            for piece, _ in self.pre_tokenise(part) if part else ():
                out.append([*(self.vocab[c] for c in piece[:-1]), self.vocab[piece[-1] + self.suffix]])
            if hit:
                out.append([self.special[hit[0]]])
                at = hit.end()
        return out

    def word(self, word: str) -> bytes:
        """A lower-case word of Latin-1."""
        if (found := self.words.get(word)) is None:
            data = word.encode()
            if len(data) <= LEAF_SYMBOLS:
                signs = word if len(data) == len(word) and word.isprintable() else "".join([self.byte_sign[b] for b in data])
                ids = [token.id for token in self.short_word(signs)]
            else:
                ids = self.tree([*(self.inner[b] for b in data[:-1]), self.final[data[-1]]])
            found = array("i", ids).tobytes()
            if len(word) <= REMEMBERED_CHARS:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[word] = found
        return found

    def run(self, run: str) -> bytes:
        """A text without white space."""
        if self.latin and (run.isascii() or max(run) <= "\xff"):
            if not self.added.search(run):
                return b"".join(map(self.word, _LATIN.findall(run.lower())))
        return array("i", [i for word in self.split(run) for i in self.tree(word)]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as 32-bit integers."""
        runs = text.split() if not any(c in text for c in _NOT_SPACE) else _RUN.findall(text)
        parts = list(map(self.runs.get, runs))
        if None in parts:
            for i, part in enumerate(parts):
                if part is None:
                    parts[i] = self.run(runs[i])
                    if len(runs[i]) <= REMEMBERED_CHARS:
                        if len(self.runs) >= REMEMBERED:
                            self.runs.clear()
                        self.runs[runs[i]] = parts[i]
        return b"".join(parts)

    def pack(self, ids: bytes) -> bytes:
        """32-bit integers in ``id_bytes`` each, the lowest first."""
        import numpy as np

        wide = np.frombuffer(ids, np.int32).astype("<i4", copy=False).view(np.uint8)
        return wide.reshape(-1, 4)[:, : self.id_bytes].tobytes()

    def unpack(self, packed: bytes) -> bytes:
        import numpy as np

        short = np.frombuffer(packed, np.uint8).reshape(-1, self.id_bytes)
        wide = np.zeros((len(short), 4), np.uint8)
        wide[:, : self.id_bytes] = short
        return wide.view("<i4").astype(np.int32, copy=False).tobytes()

    def cut(self, text: str, leaf: int) -> list[dict]:
        """Leaves of about ``leaf`` code points or symbols each; an ``open`` one ends inside a word."""
        out, at = [], 0

        def add(open_: bool, **leaf_of) -> None:
            out.append({"leaf": len(out), "open": open_, "text": None, "pieces": None} | leaf_of)

        while len(text) - at > leaf:
            space = next((i for i in range(at + leaf, at, -1) if _SPACE.match(text[i])), None)
            if space is not None:
                add(False, text=text[at:space])
                at = space
                continue
            end = found.start() if (found := _SPACE.search(text, at + leaf)) else len(text)
            pieces, size = [], 0
            for word in self.split(text[at:end]):
                while len(word) > leaf:
                    if pieces:
                        add(False, pieces=pieces)
                        pieces, size = [], 0
                    add(True, pieces=[array("i", word[:leaf]).tobytes()])
                    word = word[leaf:]
                pieces.append(array("i", word).tobytes())
                size += len(word)
                if size >= leaf:
                    add(False, pieces=pieces)
                    pieces, size = [], 0
            if pieces:
                add(False, pieces=pieces)
            at = end
        add(False, text=text[at:])
        return out

    def concatenate(self, leaves: list[dict]) -> list[int]:
        """Join encoded leaves: those of one word by a tree, the rest as they are."""
        out: list[int] = []
        word: list[list[int]] = []
        for leaf in leaves:
            word.append(leaf["ids"])
            if not leaf["open"]:
                while len(word) > 1:
                    word = [self.join(*word[i : i + 2]) if i + 1 < len(word) else word[i] for i in range(0, len(word), 2)]
                out += word.pop()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _lists(buffers: list[bytes | None]):
    """An Arrow column of id lists."""
    import numpy as np
    import pyarrow as pa

    sizes = np.array([len(b or b"") // 4 for b in buffers], np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    values = pa.array(np.frombuffer(b"".join(b or b"" for b in buffers), np.int32))
    return pa.ListArray.from_arrays(offsets, values)


@lru_cache(maxsize=2)
def _tokens(path: str):
    """The tokens' texts by id, as an Arrow column."""
    import pyarrow as pa

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    by_id = {i: token for token, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return pa.array([by_id.get(i, "") for i in range(max(by_id) + 1)], pa.string())


def _decode(lists, path: str):
    """An Arrow column of id lists as texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    tokens, values = _tokens(path), lists.values
    known = pc.and_kleene(pc.greater_equal(values, 0), pc.less(values, len(tokens)))
    if pc.all(known, skip_nulls=False, min_count=0).as_py():
        texts = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, tokens.take(values)), " ")
        return pc.if_else(lists.is_valid(), texts, None)
    names = tokens.to_pylist()
    ids = lists.to_pylist()
    return pa.array([x if x is None else " ".join([names[i] for i in x if i is not None and 0 <= i < len(names)]) for x in ids], pa.string())


def _coded(lists, path: str):
    import pyarrow as pa

    return pa.StructArray.from_arrays([lists, _decode(lists, path)], ["ids", "decoded"])


_CODED = "struct<ids:array<int>,decoded:string>"


def _encode_texts(path: str, decoded: bool):
    @F.arrow_udf(_CODED if decoded else "array<int>")
    def encode_texts(texts):
        own = encoder(path)
        lists = _lists([own.encode(t or "") for t in texts.to_pylist()])
        return _coded(lists, path) if decoded else lists

    # So that the optimizer never encodes again for each use of the ids.
    return encode_texts.asNondeterministic()


def _cut_texts(path: str, leaf: int):
    @F.arrow_udf(_LEAF_TYPE)
    def cut_texts(texts):
        import pyarrow as pa

        own = encoder(path)
        kind = pa.list_(
            pa.struct([("leaf", pa.int32()), ("open", pa.bool_()), ("text", pa.string()), ("pieces", pa.list_(pa.binary()))])
        )
        cuts = [own.cut(t, leaf) for t in texts.to_pylist()]
        return pa.array([[x | {"pieces": x["pieces"] and [own.pack(w) for w in x["pieces"]]} for x in cut] for cut in cuts], kind)

    return cut_texts


def _encode_leaves(path: str):
    @F.arrow_udf("binary")
    def encode_leaves(texts, pieces):
        import pyarrow as pa

        own = encoder(path)
        symbols = lambda word: array("i", own.unpack(word)).tolist()
        return pa.array(
            [
                own.pack(own.encode(text) if text is not None else b"".join(array("i", own.tree(symbols(w))).tobytes() for w in words))
                for text, words in zip(texts.to_pylist(), pieces.to_pylist(), strict=True)
            ],
            pa.binary(),
        )

    return encode_leaves


def _join_leaves(path: str):
    @F.arrow_udf("binary")
    def join_leaves(leaves):
        import pyarrow as pa

        own = encoder(path)
        ids = lambda leaf: array("i", own.unpack(leaf["ids"])).tolist()
        joined = (own.concatenate([x | {"ids": ids(x)} for x in of_text]) for of_text in leaves.to_pylist())
        return pa.array([own.pack(array("i", x).tobytes()) for x in joined], pa.binary())

    return join_leaves


def _unpack_ids(path: str, decoded: bool):
    @F.arrow_udf(_CODED if decoded else "array<int>")
    def unpack_ids(packed):
        own = encoder(path)
        lists = _lists([own.unpack(x) for x in packed.to_pylist()])
        return _coded(lists, path) if decoded else lists

    return unpack_ids.asNondeterministic()


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Add the token ids of every whole text and, if a name is given, the text ``decoded`` from them.

    Columns of these names are replaced. ``path`` is a vocabulary file that every
    executor can open. A null text gives no ids, as an empty one; other columns,
    repeated rows and null keys pass through.
    Texts of up to ``leaf_chars`` code points stay where they are. Longer ones are
    cut into leaves, which are dealt out singly, each once however many copies the
    text has; a text's ids meet again in the row that holds them, packed until then,
    and are decoded there. This part runs at once, and its ids are a written table.
    """
    added = [ids] if decoded is None else [ids, decoded]
    df = df.drop(*added)
    columns, key, coded = df.columns, "__key", "__coded"
    values = [F.col(coded).alias(ids)] if decoded is None else [F.col(f"{coded}.ids").alias(ids), F.col(f"{coded}.decoded").alias(decoded)]
    is_long = F.coalesce(F.length(text), F.lit(0)) > leaf_chars
    short = df.filter(~is_long).withColumn(coded, _encode_texts(path, decoded is not None)(F.col(text))).select(*columns, *values)
    long = df.filter(is_long).withColumn(key, F.sha2(text, 256))
    leaves = long.select(key, F.explode(_cut_texts(path, leaf_chars)(F.col(text))).alias("cut")).select(key, "cut.*")
    encoded = leaves.dropDuplicates([key, "leaf"]).withColumn("ids", _encode_leaves(path)(F.col("text"), F.col("pieces")))
    joined = (
        encoded.groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("leaf", "open", "ids"))).alias("leaves"))
        .select(key, _join_leaves(path)(F.col("leaves")).alias(coded))
    )
    # Written, so that a long text with many copies can be split as a skewed key.
    found = long.join(keep(joined, "long-texts", compression="zstd"), key)
    return short.unionByName(found.withColumn(coded, _unpack_ids(path, decoded is not None)(F.col(coded))).select(*columns, *values))


def decode(ids: Column, path: str) -> Column:
    """The text of an id list: the tokens' texts, one space between them.

    That is what the vocabulary's own library does where it names no decoder. Ids
    outside the vocabulary are skipped, a null list gives null.
    """

    @F.arrow_udf("string")
    def decode_ids(lists):
        return _decode(lists, path)

    return decode_ids(ids)
