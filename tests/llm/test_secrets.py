"""What the randomness battery finds, and what it leaves alone."""

import random
import string

import pytest
from pyspark.sql import functions as F

from glossmill.llm import secret_scan

WORDS = (
    "build get user data value index file path request server name count list item parse config create update delete manager handler service "
    "controller factory adapter model view cache queue worker thread async string buffer stream reader writer http client session context event "
    "listener message error exception result response status code test case unit helper base abstract default custom global local static final "
    "public private system network socket database table column row query filter sort order group join merge split kubernetes mgr cfg svc utf8 sha256"
).split()
SIGNS = string.ascii_letters + string.digits


def ordinary(rng):
    """Identifiers, paths and slugs of sixteen characters at least."""
    while True:
        many = rng.choices(WORDS, k=rng.randrange(3, 7))
        kind = rng.randrange(7)
        out = [
            "".join(w.capitalize() for w in many) + str(rng.randrange(1000)),
            "".join(w.capitalize() for w in many),
            many[0] + "".join(w.capitalize() for w in many[1:]),
            "_".join(many),
            "/".join(["api", "v2", *(w.capitalize() for w in many)]),
            "-".join(many) + f"-{rng.randrange(1900, 2100)}",
            "_".join(many).upper(),
        ][kind]
        if len(out) >= 16:
            return out


def randoms(rng, prefix="", n=32, signs=SIGNS):
    return prefix + "".join(rng.choices(signs, k=n))


PLANTED = {
    "": ("", 32, SIGNS), "ghp_": ("ghp_", 36, SIGNS), "sk_live_": ("sk_live_", 32, SIGNS), "xoxb-": ("xoxb-123456789012-1234567890123-", 32, SIGNS),
    "base64": ("", 40, SIGNS + "+/"), "base36": ("", 32, string.ascii_lowercase + string.digits),
}


@pytest.fixture(scope="module")
def corpus(spark):
    """Prose, ten thousand ordinary names, and planted secrets of six kinds."""
    rng = random.Random(17)
    rows = [(i, f"The {rng.choice(WORDS)} calls {ordinary(rng)} and the {rng.choice(WORDS)} of the {rng.choice(WORDS)}.", None) for i in range(10_000)]
    for kind, (prefix, n, signs) in PLANTED.items():
        rows += [(len(rows) + i, f"key {randoms(rng, prefix, n, signs)} of the service", kind) for i in range(200)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, planted string").repartition(8)


def test_ordinary_names_are_left_alone_and_random_ones_found(corpus):
    found = secret_scan.find(corpus).select("planted", "text", F.filter("spans", lambda s: s["kind"] == 3).alias("own"), "base_spans").collect()
    marked = [r.text for r in found if r.planted is None and r.own]
    assert len(marked) < 100, marked[:10]
    for kind, (prefix, n, _) in PLANTED.items():
        rows = [r for r in found if r.planted == kind]
        # All of the random part is covered, whether or not its prefix is; an assignment or hex pattern may have taken it.
        whole = [r for r in rows if r.base_spans or any(s.start <= 4 + len(prefix) and s.end >= 4 + len(prefix) + n for s in r.own)]
        assert len(whole) >= 0.95 * len(rows), (kind, len(whole))


def test_redaction_leaves_ordinary_text_as_it_is(corpus):
    rows = {r.doc_id: r.text for r in corpus.filter("planted is null").collect()}
    redacted = {r.doc_id: r.text for r in secret_scan.redact(corpus).filter("planted is null").collect()}
    assert sum(redacted[i] != text for i, text in rows.items()) < 100


def test_ordinary_strings_follow_the_texts(spark):
    """Counts are those of plain Python, over all texts and however these are dealt."""
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcABC12 é.\n", k=rng.randrange(50))) for _ in range(200)] + [None, "", "ab" * 700_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    pairs, letters, words = [0] * 676, 0, 0
    for t in texts:
        for a, b in zip(t or "", (t or "")[1:] + " "):
            if "a" <= a <= "z":
                letters += 1
                if "a" <= b <= "z":
                    pairs[26 * (ord(a) - 97) + ord(b) - 97] += 1
                else:
                    words += 1
    want = secret_scan.Ordinary(pairs, letters, words)
    for n in (1, 5):
        got = secret_scan.ordinary_strings(df.repartition(n))
        assert got.after == want.after and got.capitals == want.capitals


def test_tokens_are_judged_by_their_parts():
    rng, ordinary_ = random.Random(3), secret_scan.Ordinary()
    tail = randoms(rng, n=40)
    for prefix in ("", "ghp_", "xoxb-123456789012-1234567890123-"):
        start, end, level = secret_scan.judged(prefix + tail, ordinary_)
        assert level > 4 and start <= len(prefix) and end == len(prefix) + 40
    assert secret_scan.judged("short", ordinary_) is None and secret_scan.judged("a/b/c/d/e", ordinary_) is None
    assert secret_scan.judged("0" * 40, ordinary_)[2] == 0
    assert secret_scan.judged("====", ordinary_) is None
