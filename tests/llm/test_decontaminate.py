import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from kairoline.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 12, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= own - {""}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_against_brute_force(spark, most):
    rng = random.Random(9)
    some = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(["A", "b", "é", "c3", "dog"]) for _ in range(n))
    items = [(i, some(rng.randint(13, 20))) for i in range(12)] + [(100, "dog dog"), (101, "É!"), (102, None), (103, "?!"), (104, "zebra"), (None, some(14)), (0, "zebra")]
    docs = [(i, " ".join([some(rng.randint(0, 20)), rng.choice(items)[1] or "", some(rng.randint(0, 200))]) if i % 2 else some(30)) for i in range(60)]
    docs += [(None, "a zebra"), (None, "a zebra"), (7, "a zebra"), (8, None), (9, ""), (10, items[0][1])]
    df = spark.createDataFrame([(i, t, "x", True) for i, t in docs], "doc_id long, text string, items string, contaminated boolean").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_contamination(df, bench, max_broadcast_bytes=most)
    got = found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256), "contaminated")
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)
    clean = D.drop_contaminated(df, bench, max_broadcast_rows=most)
    assert clean.columns == df.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((x[0] for x in brute(docs, items) if not x[5]), key=str)


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_spans_go_and_the_rest_stays(spark, most):
    items = [(1, "alpha Beta gamma"), (2, "gamma delta"), (3, " ".join(f"w{i}" for i in range(15)))]
    docs = [(1, "Say: Alpha, beta\ngamma delta! and so on."), (2, "alpha beta only"), (3, "..." + " ".join(f"W{i}" for i in range(15))), (4, None), (5, ""), (6, "gamma DELTA"), (7, "x " + "gamma delta y " * 50), (7, "x " + "gamma delta y " * 50)]
    df = spark.createDataFrame([(i, t, "d", 1) for i, t in docs], "doc_id long, text string, digest string, spans int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.remove_spans(df, bench, max_broadcast_rows=most)
    assert got.columns == df.columns
    want = [(1, "Say: and so on."), (2, "alpha beta only"), (3, "..."), (4, None), (5, ""), (6, ""), (7, "x " + "y " * 50), (7, "x " + "y " * 50)]
    assert sorted(got.collect(), key=str) == sorted([(i, t, "d", 1) for i, t in want], key=str)
    assert D.contamination_report(got, bench).agg({"n_hit": "max"}).first()[0] == 0


def test_an_other_window_with_the_markers_key_stays(spark, monkeypatch):
    # every window of two words has the key that marks documents
    real = D._window_hash
    monkeypatch.setattr(D, "_window_hash", lambda a, at, n: F.when(F.get(a, at) == "zero", F.lit(0).cast("long")).otherwise(real(a, at, n)))
    docs = [(1, "a zero b"), (2, "nothing"), (3, "zero b c")]
    got = D.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, "zero b")], "item_id long, text string"))
    assert {r.doc_id: (r.n_hit, r["items"]) for r in got.collect()} == {1: (2, ["9"]), 2: (0, []), 3: (2, ["9"])}


def test_the_shuffled_way_carries_no_texts(spark, odd):
    bench = spark.createDataFrame([(1, "lang lang")], "item_id long, text string")
    found = D.find_contamination(odd, bench, max_broadcast_bytes=0)
    by = {r.doc_id: r for r in found.collect()}
    assert by[6].n_hit == 40_000 and found.count() == odd.count()


def test_empty_sides(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    got = D.contamination_report(odd, none)
    assert got.count() == odd.count() and got.where("contaminated").count() == 0
    assert D.contamination_report(empty, none).count() == 0 and D.drop_contaminated(odd, none).count() == odd.count()
    bench = spark.createDataFrame([(1, "lang lang"), (2, None)], "item_id long, text string")
    by = {r.doc_id: r for r in D.contamination_report(odd, bench).collect()}
    assert by[6].n_hit == 40_000 and by[6].n_words == 40_001 and by[6].contaminated and not by[1].contaminated


def test_no_python_in_the_plan(spark, odd):
    bench = spark.createDataFrame([(1, "lang lang")], "item_id long, text string")
    plan = D.contamination_report(odd, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "BroadcastHashJoin" in plan
