import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairoline.llm import elias_fano, infill


def test_elias_fano_gives_each_number_back():
    rng = np.random.default_rng(2)
    for n, top in ((0, 0), (1, 0), (1, 9), (5, 5), (300, 300), (300, 40_000), (1000, 10**9), (20_000, 20_000), (50_000, 90_000)):
        values = np.sort(rng.integers(0, top + 1, n))
        code = elias_fano.encode(np.array_split(values, 3), n, int(values[-1]) if n else 0)
        assert elias_fano.count(code) == n
        picked = range(n) if n < 2000 else rng.integers(0, n, 300).tolist()
        assert elias_fano.select(code, picked) == [int(values[i]) for i in picked]
        assert len(code) < 32 + n * (4 + max(0, np.log2((top + 1) / max(1, n)))) / 8
        with pytest.raises(IndexError):
            elias_fano.select(code, [n])


def units_of(text, units):
    if units == "chars":
        return list(text)
    if units == "lines":
        return text.splitlines(keepends=True) if text else []
    out, last_space = [], True
    for c in text:
        space = c in " \t\n\x0b\x0c\r"
        if out and not (last_space and not space):
            out[-1] += c
        else:
            out.append(c)
        last_space = space
    return out


@pytest.mark.parametrize("units", infill.UNITS)
def test_boundaries(units, monkeypatch):
    monkeypatch.setattr(infill, "_CHUNK", 7)
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("ab é漢🙂\n \t") for _ in range(rng.randint(0, 40)))
        code = infill.boundaries(text.encode(), units)
        found = elias_fano.select(code, range(elias_fano.count(code)))
        parts = [text.encode()[a:b].decode() for a, b in zip(found, found[1:], strict=False)]
        assert found[0] == 0 and parts == units_of(text, units), (text, parts)


def brute(doc_id, text, units="chars", seed=1, rate=90, spm=20):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    parts = units_of(text, units)
    n = len(parts)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (parts[:lo], parts[lo:hi], parts[hi:]))
    if not text or any(x in text for x in infill.MARKERS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("units", infill.UNITS)
def test_cuts(spark, units):
    rng = random.Random(7)
    rows = [(i if i % 50 else None, rng.choice([None, "", "x <M> y", "naïve 🙂 漢字\nzwei drei\n" * rng.randint(1, 9), "".join(rng.choice("ab <S>P\n") for _ in range(30)), "same text for all"]), "keep") for i in range(400)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    made = infill.fill_in_middle(df, units=units, suffix_first=50)
    out = made.select("*", infill.restore(F.col("output"), F.col("form")).alias("back")).collect()
    want = sorted(((i, *brute(i, t, units, spm=50), t or "") for i, t, _ in rows), key=str)
    assert sorted(map(tuple, out), key=str) == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_tables(spark, odd, empty):
    made = infill.fill_in_middle(odd, keep=("lang", "rule")).collect()
    assert len(made) == odd.count() and infill.fill_in_middle(empty).count() == 0
    text = {r.doc_id: r.text for r in odd.collect()}
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, text[r.doc_id]) for r in made)
    for bad in ({"units": "none"}, {"markers": ("<P>", "<P>", "<M>")}, {"markers": ("<<P>", "<S>", "<M>")}, {"markers": ("<P>", "[S]", "<M>")}, {"keep": ("doc_id",)}, {"keep": ("lang", "lang")}):
        with pytest.raises(ValueError):
            infill.fill_in_middle(odd, **bad)


def test_kept_columns_may_have_any_name(spark):
    df = spark.createDataFrame([(1, "some text", 5, "d", 7)], "doc_id long, text string, h1 int, _digest string, _part int")
    r = infill.fill_in_middle(df, keep=("h1", "_digest", "_part", "text")).first()
    assert (r.doc_id, r.h1, r["_digest"], r["_part"], r.text, r.n) == (1, 5, "d", 7, "some text", 9)


def test_a_text_of_most_documents_is_dealt_out(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, F.lit("one text that most of them share")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    made = infill.fill_in_middle(df)
    assert made.count() == 4000
    share = {r.doc_id: r for r in made.where("doc_id < 100").collect()}
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(i, "one text that most of them share" if i % 3 < 2 else f"text {i}") for i, r in share.items())


def test_markers_of_ones_own(spark):
    df = spark.createDataFrame([(i, f"some [text] {i} <P> here") for i in range(60)], "doc_id long, text string")
    markers = ("␂pre", "␂suf", "␂mid")
    made = infill.fill_in_middle(df, markers=markers, rate=100)
    out = made.select("doc_id", "form", infill.restore(F.col("output"), F.col("form"), markers).alias("back")).collect()
    assert all(r.form != "plain" and r.back == f"some [text] {r.doc_id} <P> here" for r in out)
