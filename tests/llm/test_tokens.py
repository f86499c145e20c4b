import numpy as np
import pytest

from kairoline.llm import tokens


@pytest.fixture(scope="module")
def encoder():
    with open(tokens.PATH, "rb") as f:
        return tokens.Encoder(f.read())


@pytest.mark.parametrize("text", ["", "Hello world\nsecond line\n", "naïve 🙂🙂 漢字 test", "a" * 5000, "\n\n\n"])
def test_spans_round_trip(encoder, text):
    first, last = encoder.spans(text)
    ids = encoder.encoding.encode_ordinary(text)
    assert len(first) == len(ids)
    if text.isascii():
        assert [text[a:b].encode() for a, b in zip(first, last, strict=True)] == [encoder.encoding.decode_single_token_bytes(i) for i in ids]
    assert not len(ids) or (first[0] == 0 and last[-1] == len(text) and (first[1:] <= last[:-1]).all() and (np.diff(last) >= 0).all())


def brute(first, last, starts, length, rule):
    ends = [*starts[1:], length]
    out = [0] * len(starts)
    for a, b in zip(first, last, strict=True):
        at = {"start": a, "end": max(b - 1, a)}.get(rule)
        if at is None:
            share = [min(b, e) - max(a, s) for s, e in zip(starts, ends, strict=True)]
            out[share.index(max(share))] += 1
        else:
            out[max(i for i, s in enumerate(starts) if s <= at)] += 1
    return out


@pytest.mark.parametrize("rule", tokens.RULES)
def test_attribution(rule):
    rng = np.random.default_rng(1)
    for _ in range(200):
        cuts = np.unique(np.concatenate([[0], rng.integers(1, 60, 12), [60]]))
        starts = np.unique(np.concatenate([[0], rng.integers(1, 60, 4)]))
        got = tokens.attribute(cuts[:-1], cuts[1:], starts, 60, rule)
        assert got.tolist() == brute(cuts[:-1].tolist(), cuts[1:].tolist(), starts.tolist(), 60, rule)


def test_lines():
    assert tokens.line_starts("").tolist() == [] and tokens.line_starts("a\n").tolist() == [0] and tokens.line_starts("a\nb\n\nc").tolist() == [0, 2, 4, 5]


def test_tables(spark, odd, empty, encoder):
    got = tokens.count_tokens(odd).collect()
    assert len(got) == odd.count() and tokens.count_tokens(empty).count() == 0
    assert all(sum(r.section_tokens) == r.n_tokens and len(r.section_tokens) == r.n_sections for r in got)
    text = {r.doc_id: r.text for r in odd.collect()}
    assert all(r.n_tokens == len(encoder.encoding.encode_ordinary(text[r.doc_id] or "")) for r in got)
    two = tokens.count_tokens(odd, fields=("rule", "text")).collect()
    assert all(r.n_sections == 2 for r in two)
    with pytest.raises(ValueError):
        tokens.count_tokens(odd, rule="none")
    with pytest.raises(ValueError):
        tokens.count_tokens(odd, max_bytes=10)
