"""A quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text. Expectation
maximisation over the counts of vote patterns estimates how often each labeller is
right, and from that the probability that a text is good. Those posteriors label the
rows on which a linear scorer over hashed features is trained; the scorer then reads
every text. No hand label is used.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that the linear scorer is trained on, at most: the first by hash.
FIT_ROWS = 5_000
#: Hashed features.
WIDTH = 2_048
#: A text is kept from this score on.
KEEP_FROM = 0.5
GOOD, BAD, NONE = 1, -1, 0
#: Labellers look at these shares; each is bad from one bar on and good up to another.
BARS = {
    "symbols": (0.2, 0.02),
    "bars": (0.1, 0.01),
    "capitals": (0.4, 0.15),
    "calls": (0.1, 0.02),
    "repeats": (0.2, 0.05),
    "bare": (0.2, 0.05),
    "signs": (0.1, 0.06),
    "sameness": (0.4, 0.2),
}


_ENDINGS = ".,;:!?#*$%&|"


def _shape(word: str) -> tuple[str, int, bool]:
    """A word with its runs of letters and digits as one sign each; how many others it has; whether it shouts."""
    core = word.rstrip(_ENDINGS)
    end = word[len(core) :]
    if core.isalpha():
        kind = "a" if core.islower() else "A" if core.isupper() else "Aa" if core[1:].islower() else None
        if kind:
            return kind + end, len(end), kind == "A" and len(core) > 1
    out, letters = [], 0
    for c in core:
        kind = c
        if c.isalpha():
            kind = "A" if c.isupper() else "a"
        elif c.isnumeric():
            kind = "0"
        letters += kind is not c or c in "Aa0"
        if kind not in "Aa0" or out[-1:] != [kind]:
            out.append(kind)
    return "".join(out) + end, len(word) - letters, len(core) > 1 and core.isupper()


@dataclass(frozen=True)
class Look:
    """What the labellers and the scorer see of a text."""

    shares: dict[str, float]
    shapes: Counter
    words: int


def look(text: str | None) -> Look:
    words = (text or "").split()
    n, text = len(words), text or ""
    if not n:
        return Look(dict.fromkeys(BARS, 0.0), Counter(), 0)
    counts, shapes = Counter(words), Counter()
    signs = size = shouted = bare = 0
    for word, k in counts.items():
        shape, other, shouts = _shape(word)
        shapes[shape] += k
        signs += other * k
        size += len(word) * k
        shouted += shouts * k
        bare += (other == len(word)) * k
    shares = {
        "symbols": sum(map(text.count, "#*$%&<>{}\\^~=")) / n,
        "bars": text.count("|") / n,
        "capitals": shouted / n,
        "calls": text.count("!") / n,
        "repeats": sum(map(operator.eq, words, words[1:])) / n,
        "bare": bare / n,
        # A few signs tell nothing in a text of a few words.
        "signs": signs / (size + 40),
        # Longer texts repeat more words: against the growth usual in text.
        "sameness": max(0.0, 1 - len(counts) / n ** 0.75),
    }
    return Look(shares, shapes, n)


def votes(seen: Look) -> tuple[int, ...]:
    """One vote for each labeller; none on a text without words."""
    if not seen.words:
        return (NONE,) * len(BARS)
    return tuple(BAD if seen.shares[k] > bad else GOOD if seen.shares[k] <= good else NONE for k, (bad, good) in BARS.items())


def features(seen: Look) -> dict[int, float]:
    """Hashed: the root of each shape's share, and the shares in tenths."""
    out: dict[int, float] = {}
    marks = {f"{k}={min(10, math.floor(v * 10))}": 1.0 for k, v in seen.shares.items()}
    for name, k in seen.shapes.items():
        marks["w" + name] = math.sqrt(k / seen.words)
    for name, value in marks.items():
        at = zlib.crc32(name.encode("utf-8", "surrogatepass")) % WIDTH
        out[at] = out.get(at, 0.0) + value
    return out


@dataclass(frozen=True)
class LabelModel:
    """``good``: the share of good texts; ``votes[j]``: how often labeller j votes what on a bad and on a good text."""

    good: float
    votes: tuple[tuple[dict[int, float], dict[int, float]], ...]

    def accuracies(self) -> list[float]:
        """Of each labeller where it votes: the probability that the vote is right."""
        out = []
        for of_bad, of_good in self.votes:
            hit = self.good * of_good[GOOD] + (1 - self.good) * of_bad[BAD]
            miss = self.good * of_good[BAD] + (1 - self.good) * of_bad[GOOD]
            out.append(hit / (hit + miss) if hit + miss else 0.5)
        return out

    def posterior(self, pattern: tuple[int, ...]) -> float:
        good, bad = self.good, 1 - self.good
        for v, (of_bad, of_good) in zip(pattern, self.votes, strict=True):
            good, bad = good * of_good[v], bad * of_bad[v]
        return good / (good + bad) if good + bad else self.good


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], steps: int = 100) -> LabelModel:
    """Accuracies from the counts of vote patterns, without any truth.

    It starts from the belief that a text with a bad vote is bad. Counts are
    smoothed, so a labeller that never votes has no weight.
    """
    total = sum(n for _, n in patterns)
    if not total:
        return LabelModel(0.5, tuple(({BAD: 1 / 3, NONE: 1 / 3, GOOD: 1 / 3},) * 2 for _ in BARS))
    belief = [0.1 if BAD in p else 0.9 if GOOD in p else 0.5 for p, _ in patterns]
    for _ in range(steps):
        good = sum(b * n for b, (_, n) in zip(belief, patterns, strict=True))
        tables = []
        for j in range(len(patterns[0][0])):
            of = [dict.fromkeys((BAD, NONE, GOOD), 1.0) for _ in range(2)]
            for b, (p, n) in zip(belief, patterns, strict=True):
                of[1][p[j]] += b * n
                of[0][p[j]] += (1 - b) * n
            tables.append(tuple({v: x / sum(t.values()) for v, x in t.items()} for t in of))
        model = LabelModel((good + 1) / (total + 2), tuple(tables))
        new = [model.posterior(p) for p, _ in patterns]
        if max(abs(a - b) for a, b in zip(new, belief, strict=True)) < 1e-6:
            break
        belief = new
    return model


def label_model(df: DataFrame, text: str = "text") -> LabelModel:
    """From the votes on all rows; gathered is one count for each pattern, ``3 ** 8`` at most."""

    @F.arrow_udf("array<int>")
    def vote(texts):
        import pyarrow as pa

        return pa.array([votes(look(t)) for t in texts.to_pylist()], pa.list_(pa.int32()))

    counts = df.select(vote(text).alias("votes")).groupBy("votes").count().collect()
    return expectation_maximisation(sorted((tuple(r["votes"]), r["count"]) for r in counts))


def train(df: DataFrame, model: LabelModel, text: str = "text", rows: int = FIT_ROWS) -> list[float] | None:
    """The linear scorer's weights, the last one the bias: a logistic fit to the posteriors.

    It sees at most ``rows`` distinct texts. None where there is nothing to learn:
    no texts, or posteriors all alike.
    """
    import numpy as np

    @F.arrow_udf("struct<at:array<int>,x:array<double>,y:double>")
    def example(texts):
        import pyarrow as pa

        out = []
        for t in texts.to_pylist():
            seen = look(t)
            vector = features(seen)
            out.append({"at": list(vector), "x": list(vector.values()), "y": model.posterior(votes(seen))})
        return pa.array(out, pa.struct([("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float64())), ("y", pa.float64())]))

    hashed = df.select(F.xxhash64(text).alias("hash"), F.col(text).alias("text")).filter("text is not null")
    chosen = hashed.select("hash").distinct().orderBy("hash").limit(rows)
    sample = hashed.join(F.broadcast(chosen), "hash").dropDuplicates(["hash"]).select(example("text").alias("e")).select("e.*").collect()
    y = np.array([r["y"] for r in sample])
    if not len(y) or y.max() - y.min() < 0.5:
        return None
    x = np.zeros((len(sample), WIDTH + 1), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(sample):
        x[i, r["at"]] = r["x"]
    # Each class weighs the same, or the rarer would hardly be learned.
    weight = np.where(y >= 0.5, 0.5 / max((y >= 0.5).sum(), 1), 0.5 / max((y < 0.5).sum(), 1)).astype(np.float32)
    w, speed = np.zeros(WIDTH + 1, np.float32), np.zeros(WIDTH + 1, np.float32)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ ((p - y) * weight) + 1e-4 * w
        speed = 0.9 * speed - grad.astype(np.float32)
        w += 0.5 * speed
    return [float(v) for v in w]


def classify(df: DataFrame, text: str = "text", keep_from: float = KEEP_FROM, rows: int = FIT_ROWS) -> DataFrame:
    """Add ``weak`` (the labellers' posterior), ``score`` (the linear scorer's) and ``kept``.

    Columns of these names are replaced. A null or empty text has no votes and no
    shapes: it gets what is left, the share of good texts and the scorer's bias.
    Where no scorer can be trained, ``score`` is ``weak``.
    """
    model = label_model(df, text)
    weights = train(df, model, text, rows)

    @F.arrow_udf("struct<weak:double,score:double>")
    def judge(texts):
        import pyarrow as pa

        weak, score = [], []
        for t in texts.to_pylist():
            seen = look(t)
            weak.append(model.posterior(votes(seen)))
            if weights is None:
                score.append(weak[-1])
            else:
                z = weights[-1] + sum(weights[at] * v for at, v in features(seen).items())
                score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return pa.StructArray.from_arrays([pa.array(weak, pa.float64()), pa.array(score, pa.float64())], ["weak", "score"])

    rest = df.drop("weak", "score", "kept")
    judged = rest.withColumn("__judged", judge(F.col(text)))
    return judged.select(*rest.columns, "__judged.weak", "__judged.score").withColumn("kept", F.col("score") >= keep_from)
