"""Fill-in-the-middle by a wavelet matrix over character classes.

A batch of texts is one UTF-8 buffer with offsets. Every byte has a class: it
continues a code point, or starts one that begins a word, goes on with one, ends a
line, or is neither. A wavelet matrix over these classes counts how often a class
stands before any byte. Such ranks add up to the number of boundaries of a unit
(code points, words or lines) before a byte, and a bisection on them finds the byte
at which the k-th unit starts: the two cuts of all texts of the batch at once.

The parts are then put in another order around three marks. A text that holds a mark
itself stays plain, so an output can always be told apart and put back.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = ("plain", "psm", "spm")
#: Percentages of texts that stay plain and, of the rest, whose suffix comes first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
#: Bytes of text that a worker cuts at a time; one longer text is cut alone.
BUFFER_BYTES = 8 << 20

# Classes of bytes, three bits each.
_CONTINUES, _BREAK, _LINE_END, _IN_WORD, _WORD_START = range(5)
#: Per unit: the classes whose bytes start a unit, and whether a unit starts after such a byte rather than at it.
UNITS = {
    "char": ((_BREAK, _LINE_END, _IN_WORD, _WORD_START), False),
    "word": ((_WORD_START,), False),
    "line": ((_LINE_END,), True),
}
_OUTPUT = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"


class WaveletMatrix:
    """Ranks of small integers: the values sorted bit by bit, from the highest one, each bit a row of the matrix."""

    def __init__(self, values, bits: int = 3):
        import numpy as np

        self.bits, self.rows, values = bits, [], np.asarray(values, np.uint8)
        for level in range(bits - 1, -1, -1):
            ones = (values >> level) & 1
            packed = np.packbits(ones, bitorder="little")
            words = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.rows.append((words, before, len(values) - int(before[-1])))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    @staticmethod
    def _ones(row, at):
        """Set bits of a row before each place."""
        import numpy as np

        words, before, _ = row
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def rank(self, value: int, at):
        """How often ``value`` stands before each place of ``at``."""
        import numpy as np

        start, end = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for level, row in zip(range(self.bits - 1, -1, -1), self.rows):
            if value >> level & 1:
                start, end = row[2] + self._ones(row, start), row[2] + self._ones(row, end)
            else:
                start, end = start - self._ones(row, start), end - self._ones(row, end)
        return end - start


@lru_cache(maxsize=1)
def _byte_classes():
    """Classes of single bytes; whether a byte of a word starts it shows beside the one before."""
    import numpy as np

    classes = np.full(256, _IN_WORD, np.uint8)
    classes[0x80:0xC0] = _CONTINUES
    classes[[0x09, 0x0B, 0x0C, 0x0D, 0x20]] = _BREAK
    classes[0x0A] = _LINE_END
    return classes


def classes_of(data, offsets):
    """The class of every byte of a buffer of texts."""
    import numpy as np

    classes = _byte_classes()[data]
    space = (classes == _BREAK) | (classes == _LINE_END)
    after_space = np.concatenate([[True], space[:-1]]) if len(data) else space
    starts = np.asarray(offsets[:-1])
    after_space[starts[starts < len(data)]] = True
    classes[after_space & (classes == _IN_WORD)] = _WORD_START
    return classes


class Boundaries:
    """Units of a buffer of texts, counted and found by ranks."""

    def __init__(self, data, offsets, unit: str = "char"):
        import numpy as np

        self.kinds, self.after = UNITS[unit]
        self.matrix = WaveletMatrix(classes_of(data, offsets))
        self.start, self.end = np.asarray(offsets[:-1], np.int64), np.asarray(offsets[1:], np.int64)
        self.base = self.before(self.start)

    def before(self, at):
        """Boundaries before each byte, over the whole buffer."""
        return sum(self.matrix.rank(kind, at) for kind in self.kinds)

    def counts(self):
        """Units of each text; what follows the last line end is a line where it is not empty."""
        n = self.before(self.end) - self.base
        if self.after:
            kinds, last = self.kinds, self.end - 1
            ended = sum(self.matrix.rank(k, self.end) - self.matrix.rank(k, last.clip(0)) for k in kinds) > 0
            n = n + ((self.end > self.start) & ~ended)
        return n

    def find(self, k):
        """The byte of each text before which ``k`` of its units lie whole; its end where there are no more."""
        import numpy as np

        # The greatest place with at most k boundaries before it; where units start after their boundary, the least with k.
        low, high = self.start.copy(), self.end.copy()
        goal = self.base + k
        while (open_ := low < high).any():
            middle = (low + high + (not self.after)) >> 1
            seen = self.before(middle)
            if self.after:
                enough = seen >= goal
                high = np.where(open_ & enough, middle, high)
                low = np.where(open_ & ~enough, middle + 1, low)
            else:
                fits = seen <= goal
                low = np.where(open_ & fits, middle, low)
                high = np.where(open_ & ~fits, middle - 1, high)
        return np.where(np.asarray(k) <= 0, self.start, low)


def code_points(data, offsets, at):
    """Code points of each text before a byte of it."""
    import numpy as np

    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    return leads[at] - leads[np.asarray(offsets[:-1])]


def _cut(texts: list[bytes], draws, unit: str) -> list[dict]:
    """Outputs of a few texts, from four draws each."""
    import numpy as np

    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    bounds = Boundaries(data, offsets, unit)
    n = bounds.counts()
    one, two = draws[0] % (n + 1), draws[1] % (n + 1)
    cuts = [bounds.find(np.minimum(one, two)), bounds.find(np.maximum(one, two))]
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    whole = draws[2] % 100 >= 100 - PLAIN_PERCENT
    suffix_first = draws[3] % 100 < SUFFIX_FIRST_PERCENT
    chars = [code_points(data, offsets, at) for at in cuts]
    out = []
    for i, text in enumerate(texts):
        if not text or whole[i] or any(m in text for m in marks):
            out.append({"n": int(n[i]), "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text.decode()})
            continue
        a, b = int(cuts[0][i] - offsets[i]), int(cuts[1][i] - offsets[i])
        prefix, middle, suffix = marks[0] + text[:a], marks[2] + text[a:b], marks[1] + text[b:]
        parts = (suffix, prefix, middle) if suffix_first[i] else (prefix, suffix, middle)
        out.append(
            {
                "n": int(n[i]),
                "form": "spm" if suffix_first[i] else "psm",
                "prefix_chars": int(chars[0][i]),
                "middle_chars": int(chars[1][i] - chars[0][i]),
                "output": b"".join(parts).decode(),
            }
        )
    return out


def draws_of(id: Column, seed: int = 1) -> list[Column]:
    """Four integers for each id: the first four groups of eight digits of the hex SHA-256 of ``seed:id``.

    A null id counts as empty.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def transform(text: Column, draws: list[Column], unit: str = "char") -> Column:
    """``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of every whole text, a struct.

    ``unit`` is what a text is cut between: ``char`` (code points), ``word`` (a word and the space after it)
    or ``line`` (a line and its end); ``n`` counts them. The prefix ends after the lesser of the first two
    draws, each modulo ``n + 1``, the middle after the greater; white space before a text's first word belongs to
    no unit and stays in front of the first cut. The third draw decides whether the text stays plain, the fourth
    the order. Null and empty texts are plain and have no units, texts that hold a mark are plain too; plain ones
    have null ``prefix_chars`` and ``middle_chars``, which count code points whatever the unit is. Rows are
    handled by themselves: repeated rows give equal results, other columns pass through.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}, not {unit!r}")

    @F.arrow_udf(_OUTPUT)
    def cut_texts(texts, a, b, c, d):
        import numpy as np
        import pyarrow as pa

        kind = pa.struct(
            [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
        )
        raw = texts.cast(pa.large_binary()).to_pylist()
        values = [np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in (a, b, c, d)]
        out, batch, size, start = [], [], 0, 0
        for i, text in enumerate([*raw, None]):
            if batch and (i == len(raw) or size + len(text or b"") > BUFFER_BYTES):
                out += _cut(batch, [v[start:i] for v in values], unit)
                batch, size, start = [], 0, i
            batch.append(text or b"")
            size += len(text or b"")
        return pa.array(out, kind)

    # Two columns are read from the result; it is not to be made twice for that.
    return cut_texts.asNondeterministic()(text, *draws)


def restore(output: Column, form: Column) -> Column:
    """The text an output was made from. Marks stand in an output only where they were put."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return (
        F.when(form == "psm", F.concat(part(1), part(3), part(2)))
        .when(form == "spm", F.concat(part(2), part(3), part(1)))
        .otherwise(output)
    )


def fill_in_middle(df: DataFrame, id: str = "doc_id", text: str = "text", unit: str = "char", seed: int = 1) -> DataFrame:
    """``df`` with the columns of ``transform`` added, or replaced where they are there already."""
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [c for c in df.columns if c not in names or c in (id, text)]
    done = df.select(*kept, transform(F.col(text), draws_of(F.col(id), seed), unit).alias("__fim"))
    return done.select(*kept, *(F.col(f"__fim.{c}").alias(c) for c in names))
