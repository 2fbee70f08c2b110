"""SimHash: fingerprints against plain XXH64, and links of keys that many fingerprints share."""

import random
import re
import time

import numpy as np
import pytest
import xxhash

from glossmill.llm import simhash
from glossmill.llm.components import components

SF = "/root/testdata/sf0.001"


def plain(text, shingle=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprints_are_those_of_plain_xxh64(spark):
    rng = random.Random(5)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += [None, "", " \n", "a", "A b", "Éa É\x0bB\x1c c", "  a\x85b  c\xa0d ", "same " * 40]
    texts += ["".join(rng.choices(["a", "B", " ", "\t", "é", "\x00", "　"], k=40)) for _ in range(100)]
    assert [simhash.simhash(t, 3) for t in texts] == [plain(t) for t in texts]
    assert simhash.simhash("x " * 200_000 + "y z", 3) == plain("x " * 200_000 + "y z")


def roots(values, links):
    parent = {int(v): int(v) for v in values}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(int(v)) for v in values]


@pytest.mark.parametrize("wild", [0, 1 << 5, 1 << 5 | 1 << 9])
def test_both_ways_to_link_a_key_agree(wild):
    rng, free = random.Random(wild), (1 << 18) - 1
    mask = ((1 << 64) - 1) & ~free & ~wild
    for _ in range(40):
        low = rng.choice([free, 0xFF, 0x3F0F])
        values = np.array(sorted({1 << 63 | rng.getrandbits(18) & low for _ in range(60)}), np.uint64)
        looked_up = simhash.neighbours(values, mask, wild, 3)
        assert all((a ^ b).bit_count() <= 3 and (a ^ b) & wild == wild for a, b in looked_up) and len(looked_up) < len(values)
        assert roots(values, looked_up) == roots(values, simhash.forest(values, wild, 3))


def test_variants_miss_nothing():
    """Any two that differ in three bits meet under a variant of a variant whose bits they may differ in."""
    rng, outer = random.Random(6), simhash.Variant(0).within(3)
    pairs = [(v, w) for v in outer for w in v.within(3)]
    for _ in range(300):
        differ = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4)))
        for variants in (outer, [w for _, w in pairs]):
            assert any(differ & v.mask == 0 and differ & v.wild == v.wild for v in variants)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_a_segment_that_very_many_share(spark):
    """Chains within one key, far apart from each other; time does not grow with the square."""
    rng, shared, chains = random.Random(7), 0xABCD1234 << 32, {}
    for chain in range(4_000):
        value = shared | rng.getrandbits(32)
        for _ in range(5):
            chains.setdefault(value, chain)
            value ^= sum(1 << b for b in rng.sample(range(32), 3))
        # One that also differs in the shared segment.
        chains.setdefault(value ^ 1 << 40, chain)
    prints = spark.createDataFrame([(signed(v),) for v in chains], "fingerprint bigint").repartition(4)
    start = time.perf_counter()
    found = simhash.links(prints, key_rows=512)
    pairs = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in found.collect()]
    assert time.perf_counter() - start < 120
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    usual = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(prints).collect()]
    assert roots(chains, pairs) == roots(chains, usual)
    assert components(found, "a", "b").count() > 20_000
