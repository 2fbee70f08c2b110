"""Cross-tokenizer alignment against comparing every token of one side with every one of the other."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from glossmill.llm import align_tokens, queries

SF = "/root/testdata/sf0.001"
PATHS = [public_tokenizers.path(name) for name in queries.ALIGNED_TOKENIZERS]
SOUP = ["word", " ", "  ", "\n", "é", "漢字", "\U0001f600", "▁", "<s>", "<|endoftext|>", "don't", "1234", "\t", "\x00", "ﬁ", "Σ", "-", "́"]
TEXTS = [None, "", " ", "\n\n", "a", "Two words.", "Two words.", "a▁b", "x" * 3_000, "base64" * 2_000 + " end", " lead and trail  ", "of words " * 6_000]


class Plain:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        self.a.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.sign, n = {chr(b): b for b in plain}, 0
        for b in range(256):
            if b not in plain:
                self.sign[chr(256 + n)], n = b, n + 1

    def bytes_a(self, i):
        return bytes(self.sign[c] for c in self.a.id_to_token(i))

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if piece[:3] == "<0x" and len(piece) == 6 else piece.replace("▁", " ").encode()

    def of(self, text):
        """Ids, groups and links, all of them."""
        text = text or ""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        bytes_a, bytes_b = [self.bytes_a(i) for i in a], [self.bytes_b(i) for i in b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            return [], [], "", []
        spans = []
        for parts in (bytes_a, bytes_b):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        inside = lambda ids, where, low, high: ",".join(str(i) for i, (s, e) in zip(ids, where) if low <= s and e <= high)
        groups = [f"{inside(a, spans[0], low, high)}|{inside(b, spans[1], low, high)}" for low, high in zip([0, *ends], ends)] if len(a) < 400 else None
        links, j = [], 0
        for x, (s, e) in zip(a, spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                links.append((x, b[k]))
                k += 1
        return a, b, groups if groups is None else ";".join(groups), links


def corpus(texts):
    """Counts over a whole corpus, plainly: rows of the query's columns, a group text of None where it was not made."""
    plain = Plain()
    found = [plain.of(t) for t in texts]
    counts = Counter(p for *_, links in found for p in set(links))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    return [
        (len(a), len(b), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), groups)
        for a, b, groups, links in found
    ]


@pytest.fixture(scope="module")
def soups():
    rng = random.Random(13)
    return TEXTS + ["".join(rng.choices(SOUP, k=rng.randrange(1, 30))) for _ in range(150)]


@pytest.mark.parametrize("head_pairs", [align_tokens.HEAD_PAIRS, 40, 0])
def test_against_all_pairs(spark, soups, head_pairs):
    """The counts of all pairs, of a few, and of none are sent to the tasks."""
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(soups)], "doc_id bigint, text string, groups string")
    got = align_tokens.alignments(df.repartition(3), *PATHS, head_pairs=head_pairs).collect()
    want = corpus(soups)
    assert len(got) == len(soups)
    for r in got:
        n_a, n_b, n_links, n_best, total, groups = want[r.doc_id]
        assert (r.n_a, r.n_b, r.n_links, r.n_best, r.count_sum) == (n_a, n_b, n_links, n_best, total), r.doc_id
        if groups is not None:
            assert (r.groups or "") == groups and r.n_groups == (groups.count(";") + 1 if groups else 0)


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(1, "Two words."), (1, "Two words."), (None, "Two words."), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = align_tokens.alignments(df, *PATHS).collect()
    one = corpus(["Two words."] * 3)[0]
    assert sorted((str(r.doc_id), r.n_links, r.count_sum) for r in got) == sorted(
        [("1", one[2], one[4]), ("1", one[2], one[4]), ("None", one[2], one[4]), ("None", 0, 0)]
    )
    assert align_tokens.alignments(df.filter("false"), *PATHS).count() == 0


def test_memory_is_renewed(soups, monkeypatch):
    usual = align_tokens.Aligner(*PATHS)
    want = usual.batch(soups)
    monkeypatch.setattr(align_tokens, "REMEMBERED", 3)
    small = align_tokens.Aligner(*PATHS)
    assert small.batch(soups) == want == small.batch(soups) and len(small.known.keys) <= 3 < len(usual.known.keys)


def test_faster_encoder_gives_the_library_s_ids():
    """Every settled character in several places, every token, and runs of a length that the faster one still takes."""
    own = align_tokens.ByteLevel(PATHS[0])
    assert own.fast is not None
    chars = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) <= 0xDFFF and align_tokens._SETTLED.fullmatch(c)]
    texts = [f" a {c}b{c} 1{c}1 {c}{c} {c}  {c}!{c}." for c in chars]
    texts += [t for t in (x.decode("utf-8", "ignore") for x in own.tokens) if align_tokens._SETTLED.fullmatch(t)]
    texts += [" " + c * (align_tokens._FAST_CHARS - 1) for c in " a\né"]
    library = own.library.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, x in zip(texts, library) if own.fast(t) != x.ids] == []


def test_query_against_all_pairs(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op13_token_alignment(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for (i, _), (n_a, n_b, n_links, n_best, total, groups) in zip(docs.items(), corpus(docs.values())):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_links, r.n_best, r.count_sum) == (n_a, n_b, n_links, n_best, total)
        if groups is not None:
            assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
            assert r.n_groups == (groups.count(";") + 1 if groups else 0)
