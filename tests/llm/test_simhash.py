import random
import re

import numpy as np
import pytest
import xxhash

from kairoline.llm import covering, simhash
from kairoline.llm.common import Scratch
from kairoline.llm.components import connected_components


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_the_definition():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 4, 50):
        text = "".join(rng.choice(["É", "a", "B", "xyz", "\u00a0"]) + rng.choice([" ", "\t", "\n ", "\x0b"]) for _ in range(n))
        assert simhash.fingerprint(text) % 2**64 == brute_fingerprint(text)
    assert simhash.fingerprint(None) == 0 == simhash.fingerprint(" \t")


def test_chunks_add_up(monkeypatch):
    text = " ".join(str(i * 7919 % 1000) for i in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    assert simhash.fingerprint(text) == whole


def test_every_close_pair_meets():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**64, 400, dtype=np.uint64)
    index, home = covering.anchors(x, 0)
    assert index.tolist() == list(range(400))
    for bits in range(3):
        y = x.copy()
        for k in range(400):
            for b in rng.choice(64, bits, replace=False):
                y[k] ^= np.uint64(1) << np.uint64(b)
        index, anchor = covering.anchors(y, 2)
        meet = set(zip(index.tolist(), anchor.tolist(), strict=True))
        assert all((k, int(home[k])) in meet for k in range(400))


def test_links_are_all_close_pairs(spark):
    rng = random.Random(3)
    words = [rng.getrandbits(64) for _ in range(40)]
    words += [w ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for w in words for _ in range(3)]
    words = sorted({w - 2**64 if w >> 63 else w for w in words})
    got = {(r.v, r.u) for r in simhash.links(spark.createDataFrame([(w,) for w in words], "fp long")).collect()}
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want and want


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100), (7, 200), (300, 301), (301, 300)] + [(rng.randint(400, 600), rng.randint(400, 600)) for _ in range(80)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.vertex: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()}
    assert got == {v: root(v) for v in parent if root(v) != v}
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "test")).count() == 0


def test_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count() and simhash.near_duplicates(empty).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == 1 and by[3].fp == by[4].fp == by[5].fp == 0 and by[5].component_id == 3
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 6, None]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_keep_one_with_repeated_and_null_ids(spark, most):
    rows = [(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (None, "x y z w"), (None, "x y z w"), (8, "p q r s"), (5, "own text of five"), (7, "own text of five"), (9, "a b c d")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), max_broadcast_rows=most).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(7, "a b c d"), (8, "p q r s"), (5, "own text of five"), (None, "x y z w")], key=str)
