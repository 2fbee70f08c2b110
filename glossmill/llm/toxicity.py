"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, reported speech, other.
Three weighted transducers read the symbols of a clause one after the other, and are
composed into one before any text is read: the first marks what a negation
reaches, the second what somebody else is reported to have said, the third what
is aimed at a target before it. A fourth reads what these write from right to left,
for targets that come after. Weights stand on the arcs and are multiplied along the
path, in the composition and over both ways; a clause weighs what the patterns it has
matched weigh, and a text is scored by its clauses.

Weights and further insults are learned from labelled rows (``fit``); the lists
below are where learning starts from.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.sources.workspace import keep

# The words that the grammar starts from.
INSULTS = (
    "idiot idiots idiotic moron morons moronic imbecile imbeciles stupid dumb dumbass fool fools loser losers scum "
    "scumbag trash garbage filth filthy vermin worthless pathetic disgusting clown clowns pig pigs bastard bastards "
    "bitch bitches asshole assholes jerk jerks creep creeps freak freaks retard retarded degenerate subhuman ugly "
    "bullshit shit shitty crap fuck fucking fucker cunt whore slut coward cowards parasite parasites brainless "
    "dummkopf idioten vollidiot trottel arschloch abschaum wertlos widerlich versager schwachkopf "
    "connard connasse salope ordure imbécile crétin crétins débile pourriture minable "
    "idiota idiotas imbécil estúpido estúpida estúpidos basura escoria cabrón puta gilipollas payaso asqueroso inútil"
).split()
THREATS = (
    "kill killing murder stab shoot strangle hurt beat burn hang destroy slaughter bomb rape "
    "töten umbringen ermorden erschießen tuer tuerai frapper matar mataré matarte golpear quemar"
).split()
TARGETS = (
    "you your yours yourself u ur they them their these those he him his she her people everyone "
    "du dich dir dein deine ihr euch sie tu toi ton te vous votre ils tú ti tus vosotros ellos usted ustedes"
).split()
NEGATIONS = "not no never neither nor isn aren wasn don doesn didn won can't cannot without nicht kein keine nie pas jamais sin nunca".split()
REPORTS = (
    "said says say saying told tells called calls calling wrote writes reported claims claimed quoted alleged accused "
    "sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió"
).split()

#: Symbols that a clause is read as.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: What is left of an insult or threat after each transducer: plain, negated, reported.
MANNERS = ("plain", "negated", "reported")
PATTERNS = tuple(f"{kind}_{manner}_{aim}" for kind in ("insult", "threat") for manner in MANNERS for aim in ("bare", "aimed"))
#: Words that a negation reaches, and words between a target and what is aimed at it.
NEGATION_REACH, TARGET_REACH = 3, 4
#: A clause of this weight counts as matched: a plain insult, an aimed threat, not a bare or a negated one, nor two reported ones.
CLAUSE_WEIGHT = 0.91
#: Labelled rows that weights are learned from, at most; they are the first by hash.
FIT_ROWS = 20_000

FEATURES = ("bias", "clauses", "strongest", *PATTERNS)

_CLAUSE_END = re.compile(r"[.!?;:\n|]")
_TOKEN = re.compile(r"[^\W\d_]+|[\"“”«»„]")
_QUOTES = frozenset("\"“”«»„")


# What an arc does to the weight of an insult or threat.
NEGATED, REPORTED, AIMED, BARE_THREAT = Fraction(1, 5), Fraction(3, 10), Fraction(3, 2), Fraction(1, 2)
_ONE = Fraction(1)


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``arcs[state, symbol] = (state, symbol, weight)``, 0 is the first state."""

    arcs: dict[tuple[int, int], tuple[int, int, Fraction]]

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes the other reads; weights are multiplied."""
        inputs = {s for _, s in self.arcs}
        arcs, number, todo = {}, {(0, 0): 0}, [(0, 0)]
        while todo:
            at = todo.pop()
            for symbol in inputs:
                mine, middle, weight = self.arcs[at[0], symbol]
                theirs, out, more = other.arcs[at[1], middle]
                to = (mine, theirs)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                arcs[number[at], symbol] = (number[to], out, weight * more)
        return Transducer(arcs)

    def run(self, symbols: Iterable[int]) -> list[tuple[int, Fraction]]:
        state, out = 0, []
        for symbol in symbols:
            state, written, weight = self.arcs[state, symbol]
            out.append((written, weight))
        return out


# After the first two transducers a symbol is 0 other, 1 target, or 2 and up: kind and manner. After the third it is
# 0 other, 1 target, or 2 and up: the pattern.
def _marked(kind: int, manner: int) -> int:
    return 2 + kind * len(MANNERS) + manner


def _negation() -> Transducer:
    """Symbols to the same, but 6 and 7 for a negated insult and threat; the state counts words left in reach."""
    arcs = {}
    for left in range(NEGATION_REACH + 1):
        for symbol in range(6):
            to = NEGATION_REACH if symbol == NEGATION else max(0, left - 1)
            reached = left and symbol in (INSULT, THREAT)
            arcs[left, symbol] = (to, symbol + 5 if reached else symbol, NEGATED if reached else _ONE)
    return Transducer(arcs)


def _report() -> Transducer:
    """From a reporting word to the end of the clause, what is said is somebody else's, negated or not."""
    arcs = {}
    for reported in (0, 1):
        for symbol in range(8):
            out, weight = OTHER, _ONE
            if symbol == TARGET:
                out = 1
            elif symbol in (INSULT, THREAT, INSULT + 5, THREAT + 5):
                kind, negated = (symbol - 1) % 5, symbol > 5
                out = _marked(kind, 2 if reported else 1 if negated else 0)
                if reported:
                    weight = REPORTED / NEGATED if negated else REPORTED
            arcs[reported, symbol] = (1 if symbol == REPORT else reported, out, weight)
    return Transducer(arcs)


def _aimed(pattern: int) -> Fraction:
    """What a pattern gains by being aimed: a threat that is neither negated nor reported says little by itself."""
    return AIMED / BARE_THREAT if PATTERNS[pattern] == "threat_plain_bare" else AIMED


def _aim() -> Transducer:
    """Writes a target, or the pattern; the state counts words left in a target's reach."""
    arcs = {}
    for left in range(TARGET_REACH + 1):
        for symbol in range(2 + 2 * len(MANNERS)):
            to, out, weight = max(0, left - 1), symbol, _ONE
            if symbol == 1:
                to = TARGET_REACH
            elif symbol > 1:
                bare = 2 * (symbol - 2)
                weight = AIMED if left else BARE_THREAT if PATTERNS[bare] == "threat_plain_bare" else _ONE
                out = 2 + bare + (1 if left else 0)
            arcs[left, symbol] = (to, out, weight)
    return Transducer(arcs)


def _aim_back() -> Transducer:
    """The same from right to left, over what ``_aim`` has written: bare patterns in reach of a target become aimed."""
    arcs = {}
    for left in range(TARGET_REACH + 1):
        for symbol in range(2 + len(PATTERNS)):
            reached = left and symbol > 1 and PATTERNS[symbol - 2].endswith("bare")
            to = TARGET_REACH if symbol == 1 else max(0, left - 1)
            arcs[left, symbol] = (to, symbol + 1 if reached else symbol, _aimed(symbol - 2) if reached else _ONE)
    return Transducer(arcs)


GRAMMAR, BACK = _negation().then(_report()).then(_aim()), _aim_back()


def read(symbols: list[int]) -> list[tuple[int, float] | None]:
    """Of every symbol of a clause the pattern that it completes and the weight of the path, or None."""
    there = GRAMMAR.run(symbols)
    back = BACK.run(out for out, _ in reversed(there))[::-1]
    return [(out - 2, float(weight * more)) if out > 1 else None for (_, weight), (out, more) in zip(there, back)]


def _pattern_weights() -> dict[str, float]:
    """The weights of all patterns, by reading a clause for each."""
    found = {}
    for trigger in (INSULT, THREAT):
        for before in ([], [NEGATION], [REPORT]):
            for after in ([], [TARGET]):
                pattern, weight = read([*before, trigger, *after])[len(before)]
                found[PATTERNS[pattern]] = weight
    return found


# Weights before learning, in log-odds.
PRIOR = {"bias": -3.0, "clauses": 1.5, "strongest": 1.0} | _pattern_weights()


@dataclass(frozen=True)
class Model:
    """Learned weights: of the features, and of each insult (1 is that of a listed one)."""

    weights: tuple[float, ...] = tuple(PRIOR[f] for f in FEATURES)
    insults: tuple[tuple[str, float], ...] = tuple((w, 1.0) for w in INSULTS)
    rows: int = field(default=0, compare=False)


@lru_cache(maxsize=4)
def _lexicon(insults: tuple[tuple[str, float], ...]):
    """Symbols of words, weights of insults, and an automaton that finds triggers in a text."""
    import ahocorasick

    symbols = dict.fromkeys(REPORTS, REPORT) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(TARGETS, TARGET)
    symbols |= dict.fromkeys(THREATS, THREAT) | dict.fromkeys((w for w, _ in insults), INSULT)
    finder = ahocorasick.Automaton()
    for word, symbol in symbols.items():
        if symbol in (INSULT, THREAT):
            finder.add_word(word, len(word))
    finder.make_automaton()
    return symbols, dict(insults), finder


def clauses(text: str, finder) -> Iterable[str]:
    """The clauses of a lower-case text that hold a trigger word, each once."""
    done = 0
    for last, size in finder.iter(text):
        start = last - size + 1
        if start < done or (start and text[start - 1].isalnum()) or text[last + 1 : last + 2].isalnum():
            continue
        ends = _CLAUSE_END.search(text, last + 1)
        end = ends.start() if ends else len(text)
        before = max(text.rfind(c, done, start) for c in ".!?;:\n|")
        yield text[max(done, before + 1) : end]
        done = end


def measure(text: str, model: Model) -> list[float]:
    """The features of a text, in the order of ``FEATURES``."""
    symbols, weights, finder = _lexicon(model.insults)
    matched, strongest, patterns = 0, 0.0, [0.0] * len(PATTERNS)
    for clause in clauses(text.lower(), finder):
        words, weight = _TOKEN.findall(clause), 0.0
        quoted = sum(w in _QUOTES for w in words) > 1
        path = read([REPORT if quoted and w in _QUOTES else symbols.get(w, OTHER) for w in words])
        for word, step in zip(words, path):
            if step:
                strength = weights.get(word, 1.0)
                patterns[step[0]] += strength
                weight += strength * step[1]
        matched += weight >= CLAUSE_WEIGHT
        strongest = max(strongest, weight)
    return [1.0, math.log1p(matched), min(strongest, 4.0), *(math.log1p(p) for p in patterns)]


def score(text: Column, model: Model) -> Column:
    """Between 0 and 1; a null or empty text has the score of one without a match."""

    @F.arrow_udf("double")
    def scores(texts):
        import pyarrow as pa

        out = []
        for t in texts.to_pylist():
            z = sum(w * x for w, x in zip(model.weights, measure(t or "", model), strict=True))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return pa.array(out, pa.float64())

    return scores(text)


def _logistic(x, y, prior, tie: float = 4.0, steps: int = 30):
    """Newton's method; a Gaussian around ``prior`` keeps what the rows do not tell."""
    import numpy as np

    w = np.array(prior, float)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + tie * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + tie * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Learn from ``(text, label)`` rows, ``rows`` of them at most: the first by the hash of the text.

    Equal texts count once, as toxic if most of them are. Rows with a null text or
    label are left out. Insults are learned from toxic rows in which no listed one
    occurs: a word counts as one if it stands in 20 of them, in a hundredth of
    them, and at least four times in five in toxic rows. Without rows of both
    labels the weights stay as they are given.
    """
    import numpy as np

    start = Model()
    known = labelled.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).select(
        F.col(text).alias("text"), F.col(label).cast("double").alias("label"), F.xxhash64(text).alias("at")
    )
    order = known.groupBy("at").agg(F.round(F.avg("label")).alias("label")).orderBy("at").limit(rows)
    sample = known.select("at", "text").join(F.broadcast(order), "at").dropDuplicates(["at"])
    of_text = keep(sample.select("label", "text"), "labelled")
    unexplained = of_text.withColumn("listed", _matches(F.col("text"), start)).filter((F.col("label") == 0) | ~F.col("listed"))
    words = unexplained.select("label", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).filter(F.length("word") > 2)
    counts = words.groupBy("word").agg(F.sum("label").alias("toxic"), F.count("*").alias("all"))
    total = unexplained.agg(F.sum("label")).first()[0] or 0
    found = counts.filter((F.col("toxic") >= max(20, total / 100)) & (F.col("toxic") >= 0.8 * F.col("all"))).collect()
    insults = start.insults + tuple(sorted((r["word"], 1.0) for r in found if r["word"] not in INSULTS))
    grown = Model(start.weights, insults)
    measured = of_text.select("label", _features(F.col("text"), grown).alias("x")).toPandas()
    if measured["label"].nunique() < 2:
        return Model(start.weights, insults, len(measured))
    x, y = np.stack(measured["x"].to_numpy()), measured["label"].to_numpy()
    learned = _logistic(x, y, np.array(start.weights))
    # A match never makes a text less toxic than none.
    learned[1:] = np.maximum(learned[1:], 0.0)
    learned[0] = min(learned[0], -1.5)
    return Model(tuple(float(w) for w in learned), insults, len(measured))


def _matches(text: Column, model: Model) -> Column:
    @F.arrow_udf("boolean")
    def matches(texts):
        import pyarrow as pa

        return pa.array([measure(t, model)[2] > 0 for t in texts.to_pylist()], pa.bool_())

    return matches(text)


def _features(text: Column, model: Model) -> Column:
    @F.arrow_udf("array<double>")
    def features(texts):
        import pyarrow as pa

        return pa.array([measure(t, model) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return features(text)


def labelled_rows(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """``(text, label)`` of at most ``rows`` labelled documents, the first by the hash of the id.

    The ids are chosen from the labels alone, so that the texts of the others are
    not moved. Ids labelled both ways count as toxic.
    """
    known = labels.filter(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(id).agg(F.max(label).alias(label))
    chosen = known.orderBy(F.xxhash64(id), id).limit(rows)
    return documents.select(id, "text").join(F.broadcast(chosen), id).select("text", label)
