import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from kairoline.llm import mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, free = total - sum(most * sizes[s] for s in capped), [s for s in names if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else share[s] for s in names}
        capped |= over
        if len(capped) == len(names):
            return {s: most * sizes[s] for s in names}


def brute(rows):
    size = defaultdict(int)
    words = lambda t: len((t or "").encode().split())
    for _, t, s in rows:
        size[s] += words(t)
    want = targets(size)
    h = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    out = []
    for s in size:
        full = int(want[s] // size[s]) if size[s] else 0
        budget, groups = want[s] - full * size[s], defaultdict(list)
        for i, t, x in rows:
            if x == s:
                groups[h(i)].append((i, words(t)))
        upto = 0
        for key in sorted(groups):
            own = sum(n for _, n in groups[key])
            more = upto + own <= budget or (upto <= budget and upto + own - budget < budget - upto)
            upto += own
            out += [(i, n, s, n * (full + more)) for i, n in groups[key]]
    return out, want


def test_against_brute_force(spark):
    rng = random.Random(6)
    for trial in range(3):
        rows = [(i if rng.random() < 0.9 else None, rng.choice([None, "", "a b", "word " * rng.randint(1, 60)]), rng.choice(["a", "a", "a", "b", "ü", None, "z"][: 3 + 2 * trial])) for i in range(300)]
        rows += rows[:5]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("target", F.lit(0))
        got = mixing.mix(df)
        want, aims = brute(rows)
        assert sorted(((r.doc_id, r["size"], r.source, r.taken) for r in got.collect()), key=str) == sorted(want, key=str)
        for r in got.select("source", "target").distinct().collect():
            assert abs(r.target - aims[r.source]) < 1e-6
        taken = got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("a"), F.max("size").alias("m"), F.max("copies").alias("c")).collect()
        assert all(r.c <= 3 for r in taken)
        copies = mixing.take(df)
        assert copies.columns == [*df.columns, "copy"] and copies.count() == got.agg(F.sum("copies")).first()[0]


def test_odd_rows(odd, empty):
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0 and mixing.take(empty).count() == 0
    a, b = (sorted(mixing.mix(odd.repartition(n)).collect(), key=str) for n in (2, 5))
    assert a == b


def test_sizes(spark):
    rows = [(None, 0), ("", 0), (" a\tb\x0bc\n", 3), ("\u00a0x y", 2)]
    got = spark.createDataFrame(rows, "t string, n int").select("n", mixing.word_count(F.col("t")).alias("got")).collect()
    assert all(r.n == r.got for r in got)


def test_nothing_is_taken_more_often_than_allowed(spark):
    rows = [(i, "", "a") for i in range(30)] + [(100, "x y", "a")] + [(200 + i, "w " * 50, "b") for i in range(20)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(50, 1))
    assert got.agg(F.max("copies")).first()[0] == 3 and got.where("source = 'a' AND size > 0").first().taken == 6
