import hashlib
import random

import numpy as np
import pytest

from kairoline.llm import frontcode, substrings


def brute(rows, length):
    """rows: in order. Kept bytes of each."""
    seen, out = set(), []
    for text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        out.append(bytes(x for x, g in zip(data, gone, strict=True) if not g))
    return out


def texts(rng, n):
    words, out = ["abc", "de", "fgh", "é", "zz", "qrs"], []
    for _ in range(n):
        if out and rng.random() < 0.4:
            o = rng.choice(out)
            out.append(rng.choice(["x", "yy", ""]) + o[rng.randint(0, len(o)) :] + rng.choice(["", "k", "abc"]))
        else:
            out.append("".join(rng.choice(words) for _ in range(rng.randint(0, 40))))
    return [*out, "", "a" * 90, None]


@pytest.mark.parametrize("crowd", [1000, 2])
def test_against_brute_force(spark, crowd):
    rng = random.Random(crowd)
    docs = texts(rng, 80)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, spans string").repartition(3)
    got = {r.doc_id: r for r in substrings.remove_repeats(df, length=12, gram=4, crowd=crowd).collect()}
    want = brute(docs, 12)
    assert [bytes(got[i].kept) for i in range(len(docs))] == want
    for i, t in enumerate(docs):
        data = (t or "").encode()
        assert got[i].n_bytes == len(data) and sum(s.b - s.a for s in got[i].spans) == len(data) - len(want[i])
        assert all(x.b < y.a for x, y in zip(got[i].spans, got[i].spans[1:], strict=False))


def test_production_parameters_on_a_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = [(r.doc_id, r.text) for r in rows.orderBy("doc_id").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in substrings.report(substrings.remove_repeats(rows)).collect()}
    seen = set()
    for i, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, np.int64)
        for s in range(len(data) - 99):
            w = hashlib.blake2b(data[s : s + 100], digest_size=12).digest()
            if w in seen:
                gone[s] += 1
                gone[s + 100] -= 1
            seen.add(w)
        kept = bytes(np.frombuffer(data, np.uint8)[np.cumsum(gone[:-1]) == 0])
        assert got[i] == (len(data), len(data) - len(kept), hashlib.sha256(kept).hexdigest())


def test_equal_polynomial_sums_do_not_make_contexts_equal(monkeypatch):
    # with one word for all bytes, all anchors have one hash; contexts still differ by their bytes
    _, up, down = substrings._powers()
    monkeypatch.setattr(substrings, "_powers", lambda: (np.ones(256, np.uint64), up, down))
    one, other = (substrings.contexts([(1, 0, t)], 12, 4) for t in (b"abcdefghijklmnop", b"abcdefghijklmnoq"))
    assert set(one[0]) == set(other[0]) and set(zip(one[1], one[2], strict=True)) != set(zip(other[1], other[2], strict=True))


def test_small_pieces_give_the_same(monkeypatch):
    rng = random.Random(8)
    data = "".join(rng.choice("ab") for _ in range(3000)).encode()
    cut = [p for p in substrings.pieces_of(1, data, 12, 100)]
    whole = substrings.contexts([(1, 0, data)], 12, 4)
    parts = substrings.contexts(cut, 12, 4)
    windows = lambda c: sorted((s, int(q)) for q, lo, hi in zip(c[4], c[5], c[6], strict=True) for s in range(lo, hi + 1))
    assert windows(whole) == windows(parts) and [s for s, _ in windows(whole)] == list(range(len(data) - 11))


def test_repeated_and_null_ids(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range(40))
    rows = [(5, long), (5, long), (None, long), (None, "q" + long), (5, "short"), (5, "short"), (1, None)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=12, gram=4).collect()
    assert len(got) == len(rows)
    assert sum(len(r.kept) for r in got if r.n_bytes == 40) == 40 and sorted(len(r.kept) for r in got if r.doc_id == 5 and r.n_bytes == 40) == [0, 40]
    assert [bytes(r.kept) for r in got if r.n_bytes == 5] == [b"short"] * 2 and [bytes(r.kept) for r in got if r.n_bytes == 41] == [b"q"]


def test_odd_rows(odd, empty):
    got = substrings.report(substrings.remove_repeats(odd))
    assert got.count() == odd.count() and substrings.remove_repeats(empty).count() == 0
    by = {r.doc_id: r for r in got.collect()}
    assert by[6].n_bytes == 200_004 and by[6].n_removed > 199_000 and by[6].n_spans == 1


def test_merge_tells_common_prefixes():
    rng = random.Random(3)
    for _ in range(300):
        runs, every = [], []
        for r in range(rng.randint(1, 9)):
            own = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))), bytes([r])) for _ in range(rng.randint(0, 12)))
            every += own
            runs.append(frontcode.encode(own))
        got = list(frontcode.merge(runs))
        assert [k for k, _, _ in got] == sorted(k for k, _ in every)
        last = b""
        for key, shared, _ in got:
            assert shared == frontcode.common_prefix(last, key)
            last = key


def test_least_in_windows():
    rng = np.random.default_rng(0)
    for w in (2, 5, 77):
        h = rng.integers(0, 6, 300).astype(np.uint64) << np.uint64(20)
        got = substrings._least_in_windows(h, w)
        assert got.tolist() == [s + int(np.argmin(h[s : s + w])) for s in range(300 - w + 1)]
