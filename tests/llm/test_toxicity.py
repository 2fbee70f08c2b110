"""The composed grammar against rules in plain Python, over whole clauses."""

import itertools
import random
from fractions import Fraction

from glossmill.llm import toxicity
from glossmill.llm.toxicity import INSULT, NEGATION, NEGATION_REACH, OTHER, PATTERNS, REPORT, TARGET, TARGET_REACH, THREAT, read


def plain(symbols):
    """Each trigger by looking around it."""
    out = []
    for i, symbol in enumerate(symbols):
        if symbol not in (INSULT, THREAT):
            out.append(None)
            continue
        reported = REPORT in symbols[:i]
        negated = NEGATION in symbols[max(0, i - NEGATION_REACH) : i]
        aimed = TARGET in symbols[max(0, i - TARGET_REACH) : i] + symbols[i + 1 : i + 1 + TARGET_REACH]
        manner = "reported" if reported else "negated" if negated else "plain"
        kind = "insult" if symbol == INSULT else "threat"
        weight = {"plain": Fraction(1), "negated": Fraction(1, 5), "reported": Fraction(3, 10)}[manner] * (Fraction(3, 2) if aimed else 1)
        if (kind, manner, aimed) == ("threat", "plain", False):
            weight /= 2
        out.append((PATTERNS.index(f"{kind}_{manner}_{'aimed' if aimed else 'bare'}"), float(weight)))
    return out


def test_short_clauses_all_of_them():
    for n in range(5):
        for symbols in itertools.product(range(6), repeat=n):
            assert read(list(symbols)) == plain(list(symbols)), symbols


def test_long_clauses():
    rng = random.Random(6)
    for _ in range(3_000):
        symbols = rng.choices([OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT], weights=[12, 3, 3, 2, 2, 0.4], k=rng.randrange(40))
        assert read(symbols) == plain(symbols)


def test_composition_is_reading_one_after_the_other():
    rng, parts = random.Random(7), (toxicity._negation(), toxicity._report(), toxicity._aim())
    for n in (0, 1, 20, 500):
        symbols = rng.choices(range(6), k=n)
        steps, weights = symbols, [Fraction(1)] * n
        for part in parts:
            told = part.run(steps)
            steps, weights = [s for s, _ in told], [w * more for w, (_, more) in zip(weights, told)]
        assert toxicity.GRAMMAR.run(symbols) == list(zip(steps, weights))


def test_prior_is_what_the_arcs_say():
    assert toxicity.PRIOR["insult_plain_bare"] == 1.0 and toxicity.PRIOR["threat_plain_bare"] == 0.5
    assert toxicity.PRIOR["threat_plain_aimed"] == 1.5 and toxicity.PRIOR["insult_reported_aimed"] == 0.45 and set(PATTERNS) <= set(toxicity.PRIOR)
