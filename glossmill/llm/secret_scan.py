r"""Secret scans by a battery of randomness tests.

Beside the plain patterns (an assignment to a telling name, an access key, a run of
hexadecimal digits) a text's long tokens are tested, as a whole and in the parts between
their separators. Each is taken to be written in the smallest encoding that holds it.
Three tests ask whether it is random in that encoding: chi-squared for uniform use of
the alphabet, runs of one character class, and serial correlation. A token that fails
one of them is patterned and has level 0.

The same three ask how random an ordinary string looks: one made of the corpus's own
words, capitalised and joined. Which letters those use, how often, how long they are and
which letters follow each other is counted over all texts; a token's letters are held
against these, its neighbours by the ratio of their chances. The three deviations are
added up to one chance that an ordinary string of that length looks as random. All
tokens that were tried count, whatever the battery said, and tokens are discovered at a
controlled false-discovery rate over all texts, in strata of length, since a short token
proves less than a long one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "random")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

# A sign of equality ends a token, so that the value of NAME=value is a token of its own.
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Encodings by alphabet, the smallest first: their size, and how many signs of it are no letters.
ENCODINGS = (
    ("digits", re.compile(r"[0-9]+"), 10, 10),
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 16, 10),
    ("letters", re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+"), 26, 0),
    ("base32", re.compile(r"[A-Z2-7]+"), 32, 6),
    ("base36", re.compile(r"[a-z0-9]+|[A-Z0-9]+"), 36, 10),
    ("base62", re.compile(r"[A-Za-z0-9]+"), 62, 10),
    ("base64", re.compile(r"[A-Za-z0-9+/_-]+"), 64, 12),
)
_SEPARATORS = re.compile(r"[+/_=-]+")
# Shares of letters in English, a to z, in a thousand. What is counted is added to a little of this.
_LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
_VOWELS = frozenset("aeiouy")
_PRIOR_PAIRS = 5_000
#: Ordinary strings follow their words' letters but for so many places.
STRAY = 0.1
#: How much wider ordinary strings scatter than one chain of letters would.
SCATTER = 1.5
#: The three deviations are taken to be so much correlated.
CORRELATED = 0.3
#: Of two neighbours in a string of letters and digits in one case, so many are of different classes.
DIGIT_CHANGES = 0.12
#: Each randomness test rejects a random token this rarely.
TEST_LEVEL = 0.001
#: Share of ordinary strings among what is discovered, at most.
FALSE_DISCOVERIES = 0.001
#: From this level on a token is discovered, however many were tried.
SURE = 300.0
#: Strata of length begin here.
STRATA = (16, 24, 32, 48, 64)


def _normal(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _log_above(z: float) -> float:
    """The natural logarithm of the chance of more than ``z``; by its asymptotic series where ``erfc`` comes near 0."""
    if z < 30:
        return math.log(0.5 * math.erfc(z / math.sqrt(2)))
    return -z * z / 2 - math.log(z * math.sqrt(2 * math.pi)) + math.log1p(-1 / z**2 + 3 / z**4)


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def encoding(body: str) -> tuple[str, int, int] | None:
    """The smallest encoding that holds a body; letters in one case may begin with a capital."""
    return next(((name, size, digits) for name, pattern, size, digits in ENCODINGS if pattern.fullmatch(body)), None)


def _prior() -> list[list[float]]:
    """Pairs of a text nobody has seen: letters by their shares, vowels and consonants in turn more often than not."""
    total, rows = sum(_LETTERS), []
    for i in range(26):
        row = [share / total * (1.3 if (chr(97 + i) in _VOWELS) != (chr(97 + j) in _VOWELS) else 0.7) for j, share in enumerate(_LETTERS)]
        rows.append([_LETTERS[i] / total * 0.99 * x / sum(row) for x in row] + [_LETTERS[i] / total * 0.01])
    return rows + [[0.001 * share / total for share in _LETTERS] + [0.009]]


class Ordinary:
    """How ordinary strings are written, from counts of neighbouring letters (26 by 26), of letters and of words."""

    def __init__(self, pairs: list[int] | None = None, letters: int = 0, words: int = 0):
        pairs = pairs or [0] * 676
        weight = _PRIOR_PAIRS + sum(pairs)
        # Digits are not counted: in ordinary strings they are a few, and stand side by side.
        seen = [[pairs[26 * i + j] if i < 26 and j < 26 else 0 for j in range(27)] for i in range(27)]
        table = [[seen[i][j] + (_PRIOR_PAIRS if i < 26 and j < 26 else weight) * p for j, p in enumerate(row)] for i, row in enumerate(_prior())]
        whole = sum(map(sum, table))
        self.share = [sum(row) / whole for row in table]
        self.after = [[x / sum(row) for x in row] for row in table]
        #: Of the letters of joined words so many are capitals.
        self.capitals = (words + 400) / (letters + 2_000)
        self.known = {name: self._expected(name, size, digits) for name, _, size, digits in ENCODINGS}

    def _expected(self, name: str, size: int, digits: int) -> dict:
        """By encoding: ratios of neighbours, their mean and variance, how unevenly signs are used, how often classes change."""
        letters = [i for i in range(26) if name != "hex" or i < 6]
        random = [(size - digits) / len(letters) / size if i in letters and size > digits else 0.0 for i in range(26)] + [digits / size]
        kept = [i for i in range(27) if random[i]]
        ratios, mean, square, weight = {}, 0.0, 0.0, 0.0
        for i in kept:
            inside = sum(self.after[i][j] for j in kept)
            for j in kept:
                usual = self.after[i][j] / inside
                ratio = math.log(random[j] / ((1 - STRAY) * usual + STRAY * random[j]))
                ratios[i, j] = ratio
                mean += self.share[i] * usual * ratio
                square += self.share[i] * usual * ratio * ratio
            weight += self.share[i]
        mean, square = mean / weight, square / weight
        cased = (1 - self.capitals) ** 2 + self.capitals**2 if name in ("base62", "base64") else 1.0
        held = sum(self.share[i] for i in kept)
        squares = sum((self.share[i] / held) ** 2 * cased for i in kept if i < 26) + ((self.share[26] / held) ** 2 / digits if digits else 0.0)
        changes = min(0.5, 2 * self.capitals) if name in ("base62", "base64") else DIGIT_CHANGES
        return {"ratios": ratios, "mean": mean, "variance": max(square - mean * mean, 1e-6), "uneven": max(size * squares - 1, 0.3), "changes": changes}


def _sign(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else 26


@lru_cache(maxsize=1)
def _unseen() -> Ordinary:
    return Ordinary()


def battery(body: str, ordinary: Ordinary | None = None) -> tuple[str, float] | None:
    """The inferred encoding and -log10 of the chance that an ordinary string looks so random; 0 where a test finds it patterned.

    None where it is too short or holds other signs. Without ``ordinary`` what is known of English stands for it.
    """
    n, found = len(body), encoding(body)
    if n < STRATA[0] or found is None:
        return None
    name, size, _ = found
    usual = (ordinary or _unseen()).known[name]
    lower = body.lower()
    # Chi-squared against a uniform alphabet; by its mean and variance, as n is small for a table.
    counts = Counter(lower if name in ("hex", "letters") else body)
    chi = size / n * sum(c * c for c in counts.values()) - n
    free = size - 1
    if 1 - _normal((chi - free) / math.sqrt(2 * free * (1 - 1 / n))) < TEST_LEVEL:
        return name, 0.0
    mean, spread = free + (n - 1) * usual["uneven"], math.sqrt(2 * free + 4 * n * usual["uneven"])
    deviations = [(mean - chi) / spread]
    # Runs of character classes, given how many of each class there are.
    classes = [_class(c) for c in (lower if name == "letters" else body)]
    changes = sum(a != b for a, b in zip(classes, classes[1:]))
    share = 1 - sum(c * (c - 1) for c in Counter(classes).values()) / (n * (n - 1))
    if share:
        scatter = math.sqrt((n - 1) * share * (1 - share)) or 1.0
        if 2 * (1 - _normal(abs(changes - (n - 1) * share) / scatter)) < TEST_LEVEL:
            return name, 0.0
        often = usual["changes"]
        deviations.append((changes - 0.5 - (n - 1) * often) / math.sqrt((n - 1) * often * (1 - often)))
    # Serial correlation of neighbours: by character code against none, by the ratio of their chances against words.
    codes = [ord(c) for c in body]
    middle = sum(codes) / n
    total = sum((c - middle) ** 2 for c in codes)
    serial = sum((a - middle) * (b - middle) for a, b in zip(codes, codes[1:])) / total if total else 1.0
    if 2 * (1 - _normal(abs(serial * math.sqrt(n) + 1 / math.sqrt(n)))) < TEST_LEVEL:
        return name, 0.0
    # Digits tell nothing by what follows them.
    if name != "digits":
        signs, ratios = [_sign(c) for c in lower], usual["ratios"]
        ratio = sum(ratios[pair] for pair in zip(signs, signs[1:]))
        deviations.append((ratio - (n - 1) * usual["mean"]) / math.sqrt(SCATTER * (n - 1) * usual["variance"]))
    m = len(deviations)
    z = sum(deviations) / math.sqrt(m + m * (m - 1) * CORRELATED)
    return name, max(0.0, -_log_above(z) / math.log(10)) if z > 0 else 0.0


def judged(token: str, ordinary: Ordinary) -> tuple[int, int, float] | None:
    """Where in a token the most telling part is, and its level, less what so many looks cost; None if it is too short.

    The whole is taken without its separators. A part, which a telling prefix stands before, has to say clearly more.
    """
    parts = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9]+", token)]
    looks = [(a, b, found[1]) for a, b in parts if len(parts) > 1 and (found := battery(token[a:b], ordinary))]
    whole = battery(_SEPARATORS.sub("", token), ordinary)
    if whole is None:
        return None
    best = max(looks, key=lambda x: x[2], default=(0, 0, -math.inf))
    start, end, level = best if best[2] > whole[1] + 2 else (0, len(token), whole[1])
    return start, end, max(0.0, level - math.log10(1 + len(looks)))


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """``(start, kind, end, start of the value)`` of the base patterns, in code points, sorted."""
    out = []
    lower = text.lower()
    if any(name in lower for name in _NAMES):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def tested_spans(text: str, base: list[tuple[int, int, int, int]], ordinary: Ordinary) -> list[tuple[int, int, float]]:
    """``(start, end, -log10 p)`` of every token that was tried and lies in no base span; place by place."""
    out, at, reach = [], 0, 0
    for m in _TOKEN.finditer(text):
        found = judged(m[0], ordinary)
        if found is None:
            continue
        start, end = m.start() + found[0], m.start() + found[1]
        while at < len(base) and base[at][0] <= start:
            reach = max(reach, base[at][2])
            at += 1
        if end > reach:
            out.append((start, end, found[2]))
    return out


def ordinary_strings(df: DataFrame, text: str = "text") -> Ordinary:
    """How the words of all texts are written: counts of neighbouring small letters, of these letters and of their runs.

    Small letters after small letters: what is random in both cases has few such neighbours, so secrets that the
    texts hold hardly count. What is gathered is 678 sums, whatever the corpus.
    """

    def counted(batches):
        import numpy as np
        import pyarrow as pa

        sign = np.full(256, 26, np.int64)
        sign[97:123] = np.arange(26)
        for batch in batches:
            joined = b" ".join(x for x in batch.column(0).cast(pa.binary()).to_pylist() if x) + b" "
            sums = np.zeros(27 * 27, np.int64)
            for start in range(0, len(joined), 1 << 20):
                # One more at the end, so that no pair is lost between two stretches.
                signs = sign[np.frombuffer(joined[start : start + (1 << 20) + 1], np.uint8)]
                sums += np.bincount(27 * signs[:-1] + signs[1:], minlength=27 * 27)
            pairs = sums.reshape(27, 27)
            values = [*pairs[:26, :26].ravel().tolist(), int(pairs[:26].sum()), int(pairs[:26, 26].sum())]
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(values)), pa.int32()), "n": pa.array(values, pa.int64())})

    sums = df.select(F.col(text).cast("string")).mapInArrow(counted, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    found = {r["place"]: r["n"] for r in sums.collect()}
    return Ordinary([found.get(i, 0) for i in range(676)], found.get(676, 0), found.get(677, 0))


_SCANNED = "struct<base:array<struct<start:int,kind:int,end:int,value:int>>,tested:array<struct<start:int,end:int,level:double>>>"


def scan(text: Column, ordinary: Ordinary) -> Column:
    """Base spans, and all tokens that were tried with their levels (-log10 of a chance); null counts as empty."""

    @F.arrow_udf(_SCANNED)
    def scanned(texts):
        import pyarrow as pa

        base_kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "kind", "end", "value")]))
        tested_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("level", pa.float64())]))
        base, tested = [], []
        for t in texts.to_pylist():
            found = base_spans(t or "")
            base.append([dict(zip(("start", "kind", "end", "value"), s)) for s in found])
            tested.append([{"start": s, "end": e, "level": p} for s, e, p in tested_spans(t or "", found, ordinary)])
        return pa.StructArray.from_arrays([pa.array(base, base_kind), pa.array(tested, tested_kind)], ["base", "tested"])

    return scanned.asNondeterministic()(text)


def _stratum(length: Column) -> Column:
    out = F.lit(0)
    for i, start in enumerate(STRATA):
        out = F.when(length >= start, i).otherwise(out)
    return out


def bars(scanned: DataFrame, found: str = "found", rate: float = FALSE_DISCOVERIES) -> list[float]:
    """The level from which a token is discovered, for each stratum of length (Benjamini and Hochberg).

    Over all texts: what is gathered is a count for each tenth of a level in each
    stratum, a few thousand at most whatever the corpus. All tokens that were tried
    count, those that the battery found patterned too.
    """
    tested = scanned.select(F.explode(f"{found}.tested").alias("t"))
    length = F.col("t.end") - F.col("t.start")
    # Down to the tenth, so a level is never taken for more than it is; levels beyond SURE count as one, as no bar is higher.
    counts = tested.groupBy(_stratum(length).alias("stratum"), F.floor(F.least("t.level", F.lit(SURE)) * 10).cast("int").alias("tenth")).count().collect()
    out = []
    for stratum in range(len(STRATA)):
        tenths = sorted(((r["tenth"], r["count"]) for r in counts if r["stratum"] == stratum), reverse=True)
        tried, discovered, bar = sum(n for _, n in tenths), 0, math.inf
        for tenth, n in tenths:
            discovered += n
            if tried * 10 ** (-tenth / 10) <= rate * discovered:
                bar = tenth / 10
        out.append(bar)
    return out


def discovered(found: Column, levels: list[float]) -> Column:
    """All spans that stand: ``(start, kind, end, value)``, by start and then by kind."""
    own = F.filter(
        found["tested"],
        lambda t: t["level"] >= F.element_at(F.array(*map(F.lit, levels)), _stratum(t["end"] - t["start"]) + 1),
    )
    made = F.transform(own, lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end"), t["start"].alias("value")))
    return F.sort_array(F.concat(found["base"], made))


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(df: DataFrame, text: str = "text", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """Add ``base_spans`` and ``spans`` (arrays of ``(start, kind, end, value)``); columns of these names are replaced.

    Kinds number ``KINDS``. Offsets are code points, ends exclusive; ``value`` is where
    the secret itself starts. A null or empty text has no spans. Texts are read three
    times: for the words, for the levels of discovery and for the spans; no text is moved.
    """
    rest = df.drop("base_spans", "spans")
    scanned = rest.withColumn("__found", scan(F.col(text), ordinary_strings(df, text)))
    levels = bars(scanned, "__found", rate)
    return scanned.withColumn("base_spans", F.col("__found.base")).withColumn("spans", discovered(F.col("__found"), levels)).drop("__found")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """``df`` with the value of every span replaced by ``mark``; spans that touch or overlap become one mark.

    Texts without spans, null ones too, stay as they are.
    """

    ordinary = ordinary_strings(df, text)
    levels = bars(df.select(scan(F.col(text), ordinary).alias("found")), "found", rate)

    @F.arrow_udf("string")
    def replaced(texts):
        import pyarrow as pa

        out = []
        for t in texts.to_pylist():
            base = base_spans(t or "")
            found = [(value, end) for _, _, end, value in base]
            for start, end, level in tested_spans(t or "", base, ordinary):
                if level >= levels[sum(end - start >= s for s in STRATA) - 1]:
                    found.append((start, end))
            merged: list[list[int]] = []
            for start, end in sorted(found):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            pieces, at = [], 0
            for start, end in merged:
                pieces += [t[at:start], mark]
                at = end
            out.append("".join([*pieces, t[at:]]) if merged else t)
        return pa.array(out, pa.string())

    return df.withColumn(text, replaced(F.col(text)))
