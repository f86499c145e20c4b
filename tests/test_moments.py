import random

import pytest

from kairoline.operators import moments as M
from kairoline.sources.store import RECORDS, CorruptStore, MomentStore

KEY = "ab" * 32


def rows(spark, items):
    return spark.createDataFrame([(KEY, float(a), float(b), kind, c, "own/x", 1, p) for a, b, kind, c, p in items], RECORDS)


def generated(spark, n=400):
    """Points and spans on a grid coarse enough that edges often meet the query's."""
    rng = random.Random(12)
    out = []
    for k in range(n):
        a = rng.randrange(0, 24) / 4
        long = rng.choice([0, 0, 1, 2, 5, 11]) / 4
        out.append((a, a + long, "beat" if long == 0 else rng.choice(["silence", "shot"]), rng.randrange(5) / 4, rng.choice([None, "x", "y"])))
    return out, rows(spark, out)


def touches(a, b, low, high):
    """Whether any instant of a record lies in [low, high); a record of no length is one instant, others lack their end."""
    if a == b:
        return low <= a < high
    return low < high and max(a, low) < min(b, high)


def test_time_ranges_against_a_plain_predicate(spark):
    items, df = generated(spark)
    for low, high in ((0.0, 6.0), (1.25, 1.5), (2.0, 2.0), (3.75, 9.0), (0.0, 0.25), (11.0, 12.0)):
        got = M.filter_and_sort(df, M.MomentQuery().with_time_range(low, high)).count()
        assert got == sum(touches(a, b, low, high) for a, b, *_ in items)


def test_all_filters_together(spark):
    items, df = generated(spark)
    q = M.MomentQuery().with_kind("shot").with_minimum_confidence(0.5).with_time_range(1.0, 4.0)
    assert M.filter_and_sort(df, q).count() == sum(kind == "shot" and c >= 0.5 and touches(a, b, 1.0, 4.0) for a, b, kind, c, _ in items) > 0


def test_every_limit_gives_a_prefix_of_the_whole_order(spark):
    items, df = generated(spark, 60)
    q = M.MomentQuery().with_kind("silence")
    whole = [tuple(r) for r in M.filter_and_sort(df, q).collect()]
    for limit in (1, len(whole) - 1, len(whole), len(whole) + 7):
        got = M.query_with_limit(df, q, limit).orderBy("position").collect()
        assert [tuple(r)[: len(whole[0])] for r in got] == whole[:limit]
        assert {r.truncated for r in got} == {limit < len(whole)}
    for bad in (0, -3, M.MAX_LIMIT + 1):
        with pytest.raises(ValueError):
            M.query_with_limit(df, q, bad)


def test_order_is_that_of_a_sort_by_hand(spark):
    items, df = generated(spark, 80)
    key = lambda x: (x[0], x[1], x[2], -x[3], x[4] is not None, x[4] or "")
    got = [(r.start_seconds, r.end_seconds, r.kind, r.confidence, r.payload) for r in M.filter_and_sort(df, M.MomentQuery()).collect()]
    assert got == sorted(items, key=key)


def test_store(spark, tmp_path):
    store = MomentStore(spark, f"file://{tmp_path}/m")
    scope = {"content_key": KEY, "analyzer": "own/x", "version": 1}
    store.replace_batch(scope, rows(spark, [(0, 1, "silence", 1.0, None), (2, 2, "beat", 0.5, "p")]))
    assert store.records().count() == 2 and M.batch_exists(store.batches(), scope)
    for bad in ([(1, 0, "beat", 1.0, None)], [(0, 1, "Bad", 1.0, None)], [(0, 1, "beat", 1.0, None)] * 2):
        with pytest.raises(ValueError):
            store.replace_batch(scope, rows(spark, bad))
    assert store.checked().count() == 2
    store.replace_batch(scope, rows(spark, []))
    again = MomentStore(spark, f"file://{tmp_path}/m")
    assert again.records().count() == 0 and M.batch_exists(again.batches(), scope)
    assert again.delete_batch(scope) and not again.delete_batch(scope)
    (tmp_path / "m" / "v99.commit").write_text("7 nothing\n")
    with pytest.raises(CorruptStore):
        MomentStore(spark, f"file://{tmp_path}/m")


def test_store_rewrites_one_bucket_and_forgets_old_ones(spark, tmp_path):
    store = MomentStore(spark, f"file://{tmp_path}/m")
    keys = ["ab" * 32, "cd" * 32, "abcd" * 16]
    for n, key in enumerate([*keys, keys[0]]):
        new = spark.createDataFrame([(key, float(i), float(i), "beat", 1.0, "own/x", 1, str(n)) for i in range(n + 1)], RECORDS)
        before = store._folders(store._number())
        store.replace_batch({"content_key": key, "analyzer": "own/x", "version": 1}, new)
        after = store._folders(store._number())
        assert {b for b in after if after[b] != before.get(b)} == {key[:2]}
    assert store.records().count() == 2 + 3 + 4 and store.records(keys[0]).count() == 4 and store.records(keys[1]).count() == 2
    assert store.query(M.MomentQuery(), 10, keys[2]).count() == 3 and store.records("ef" * 32).count() == 0
    assert store.vacuum(1) == 2 and store.vacuum(1) == 0 and MomentStore(spark, f"file://{tmp_path}/m").records().count() == 9
