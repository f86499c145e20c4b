import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kairoline.llm import ann


def exact(rows, n):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in rows:
        if i % 100 == 0:
            near = sorted({(float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in rows if j != i})[:n]
            out[i] = [j for _, j in near]
    return out


def test_recall(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(1500, 16)).astype(np.float32))]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    want = exact(rows, 10)
    by = {}
    for r in got:
        by.setdefault(r.query_id, {})[r["rank"]] = r
    assert set(by) == set(want)
    assert np.mean([len({r.vec_id for r in by[q].values()} & set(want[q])) / 10 for q in want]) > 0.95
    for q, own in by.items():
        assert sorted(own) == list(range(1, 11))
        scores = [(own[k].score, own[k].vec_id) for k in sorted(own)]
        assert scores == sorted(scores)
        x = dict(rows)
        assert all(np.isclose(own[k].score, np.linalg.norm(np.array(x[q]) - np.array(x[own[k].vec_id])), atol=1e-9) for k in own)


def shaped(kind, rows, dim):
    v = np.random.default_rng(8).normal(size=(rows, dim))
    if kind == "offset":
        v += 1000
    elif kind == "one component":
        v[:, 3] += 1000
    elif kind == "two groups":
        v[::2] += 1e5
    elif kind == "magnitudes":
        v *= np.exp(np.random.default_rng(9).normal(size=(rows, 1)) * 4)
    elif kind == "one huge":
        v[7] *= 1e200
    elif kind == "a huge query":
        v[100] *= 1e200
    return v


@pytest.mark.parametrize(("kind", "rows"), [*((k, 1500) for k in ("offset", "one component", "two groups", "magnitudes", "a huge query")), ("one huge", 10_000)])
def test_recall_whatever_the_vectors_shape(spark, kind, rows):
    v = shaped(kind, rows, 16)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 100 == 0).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert all(own == sorted(own) and len(own) == 10 for own in found.values()) and len(found) == rows // 100
    hits = 0
    for q, own in found.items():
        diff = np.abs(v - v[q])
        top = diff.max(axis=1)
        d = top * np.sqrt(((diff / np.where(top > 0, top, 1)[:, None]) ** 2).sum(axis=1))
        order = np.lexsort((np.arange(rows), d))
        hits += len({i for i in order.tolist() if i != q and i in {x for _, x in own}} & set([i for i in order.tolist()[:11] if i != q][:10]))
    assert hits / (10 * len(found)) >= 0.95


@pytest.mark.parametrize("least", [0.9, 2.0])
def test_a_search_that_misses_is_widened_and_at_last_exact(spark, monkeypatch, least):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 8)))]
    beams = []
    real = ann.Graph.search
    monkeypatch.setattr(ann.Graph, "search", lambda self, starts, beam, hops: (beams.append(beam), real(self, starts, beam, hops).where("node % 3 > 0"))[1])
    monkeypatch.setattr(ann, "LEAST", least)
    monkeypatch.setattr(ann, "BLOCK", 4)
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    assert beams == [192, 384, 768, 1536]
    want = exact(rows, 10)
    for q in want:
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want[q]


def test_found_and_made_up_answers_are_ranked_together(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(150, 4)))]
    real = ann.Graph.search
    far = {q: set(exact(rows, 149)[q][100:104]) for q in (0, 100)}
    monkeypatch.setattr(ann, "LEAST", 0.0)
    monkeypatch.setattr(ann.Graph, "search", lambda self, *a: real(self, *a).where(f"node IN ({', '.join(map(str, far[0] | far[100]))})"))
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    for q in (0, 100):
        own = [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        assert own == sorted(own) and len(own) == 10


@pytest.mark.parametrize("far", [1, 6])
def test_outliers_and_small_far_groups(spark, far):
    # a narrow cone, and opposite to it a vector alone in its buckets, or six that share theirs with nobody else
    rng = np.random.default_rng(3)
    axis = np.eye(1, 12)[0] * 20
    rows = [(i, [float(x) for x in axis + v]) for i, v in enumerate(rng.normal(size=(300, 12))) if i % 100]
    rows += [(1000 + i, [float(x) for x in -axis + v]) for i, v in enumerate(rng.normal(size=(far, 12)) / 10)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, leaf=8).collect()
    found, want = [r.vec_id for r in sorted(got, key=lambda r: r["rank"])], exact(rows, 10)[1000]
    assert len(found) == 10 and found[: far - 1] == want[: far - 1]
    assert len(set(found) & set(want)) >= 9


@pytest.mark.parametrize("size", [1e25, 1e-25, 1e200])
def test_huge_and_tiny_vectors(spark, size):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v * size]) for i, v in enumerate(rng.normal(size=(400, 8)))]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    want = exact([(i, [x / size for x in v]) for i, v in rows], 10)
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append(r.vec_id)
        assert np.isclose(r.score / size, np.linalg.norm(np.array(rows[r.query_id][1]) / size - np.array(rows[r.vec_id][1]) / size))
    assert {q: len(v) for q, v in by.items()} == {q: 10 for q in want}
    assert np.mean([len(set(by[q]) & set(want[q])) / 10 for q in want]) > 0.95


def test_a_search_that_finds_too_few_is_made_up_exactly(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(150, 4)))] + [(100, [0.1, 0.2, 0.3, 0.4])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    real = ann.Graph.search
    monkeypatch.setattr(ann.Graph, "search", lambda self, *a: real(self, *a).where("q % 200 <> 0 AND d < 0"))
    got = ann.nearest(df, F.col("vec_id") % 100 == 0).collect()
    found = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in got}}
    assert found[0] == exact(rows, 10)[0] and len(found[100]) == 10 and [r["rank"] for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))] == [*range(1, 11)] * 2


def test_old_pairs_are_not_compared_again():
    vectors = np.array([[0.0, 1.0], [0.0, 0.9], [1.0, 0.0]])
    coder = ann.Coder(vectors)
    codes = next(ann._codes(coder)(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(vectors.tolist())], ["id", "e"])]))).column(1)

    def pairs(*fresh):
        batch = pa.RecordBatch.from_arrays([pa.array([7, 7, 7]), pa.array([1, 2, 3]), codes, pa.array([np.inf] * 3), pa.array(fresh)], ["g", "id", "code", "kth", "fresh"])
        return {(x, y) for b in ann._compare(5, coder)(iter([batch])) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}

    assert pairs(False, False, False) == set() and pairs(True, False, False) == {(1, 2), (1, 3), (2, 1), (3, 1)}
    assert len(pairs(True, True, True)) == 6


def test_odd_vectors_ties_and_copies(spark):
    same = [1.0, 0.0]
    rows = [(0, same), (100, same), (3, same), (4, same), (200, [0.0, 1.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [None, 1.0]), (9, [float("nan"), 1.0]), (10, [float("inf"), 1.0]), (None, same), (3, same)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, n=3).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by == exact(rows, 3) == {0: [3, 4, 100], 100: [0, 3, 4], 200: [0, 3, 4]}


def test_empty_and_mixed_lengths(spark):
    kind = "vec_id long, embedding array<float>, score double"
    assert ann.nearest(spark.createDataFrame([], kind), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0], 2.0)], kind), F.col("vec_id") % 100 == 0).count() == 0
    with pytest.raises(ValueError, match="components"):
        ann.nearest(spark.createDataFrame([(0, [1.0], 2.0), (1, [1.0, 2.0], 1.0)], kind), F.col("vec_id") % 100 == 0)


def test_groups_are_never_cut():
    rng = np.random.default_rng(1)
    g = np.sort(rng.integers(0, 40, 500))
    whole = pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.arange(500))], ["g", "x"])
    for size in (1, 7, 100, 500):
        out = list(ann._by_group(iter([whole.slice(i, size) for i in range(0, 500, size)])))
        assert pa.Table.from_batches(out).equals(pa.Table.from_batches([whole]))
        seen = [set(b.column(0).to_pylist()) for b in out]
        assert sum(map(len, seen)) == len(set(g.tolist()))


def test_a_search_starts_near_its_query(spark):
    """the graph begins with most of the near edges, and searches with the near nodes of several cells, so that rounds and hops are few."""
    from kairoline.llm.common import Scratch

    rng = np.random.default_rng(12)
    v = rng.normal(size=(4000, 24))
    nodes = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, embedding array<double>")
    graph = ann.Graph(nodes, Scratch(spark, "test"), leaf=64, rounds=0)
    edges = {}
    for r in graph.edges.collect():
        edges.setdefault(r.id, set()).add(r.nbr)
    chosen = range(0, 4000, 40)
    near = {q: [i for i in np.argsort(((v - v[q]) ** 2).sum(axis=1)).tolist() if i != q][:10] for q in chosen}
    assert np.mean([len(edges[q] & set(near[q])) / 10 for q in chosen]) > 0.6
    starts = spark.createDataFrame([(q,) for q in chosen], "q long")
    _, asked, begun = graph._begun(starts)
    got = {}
    for r in begun.collect():
        got.setdefault(r.q, {})[r.node] = r.d
    assert all(q not in own for q, own in got.items()) and np.mean([len(got[q].keys() & set(near[q])) / 10 for q in chosen]) > 0.75
    # no more than a share of all rows
    assert max(map(len, got.values())) < 2000


def test_queries_see_the_nodes_of_their_group():
    vectors = np.array([[0.0, 1.0], [0.0, 0.9], [1.0, 0.0], [0.5, 0.5]])
    coder = ann.Coder(vectors)
    codes = next(ann._codes(coder)(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(vectors.tolist())], ["id", "e"])]))).column(1)
    batch = pa.RecordBatch.from_arrays([pa.array([7, 7, 7, 7, 8]), pa.array([1, 2, 3, 1, 4]), pa.concat_arrays([codes.take(pa.array([0, 1, 2, 0])), codes.slice(3)]), pa.array([False, False, False, True, True])], ["g", "id", "code", "asked"])
    out = pa.Table.from_batches(ann._seen(1, coder)(iter([batch]))).to_pylist()
    assert [(r["q"], r["node"]) for r in out] == [(1, 2)]
    both = pa.Table.from_batches(ann._seen(5, coder)(iter([batch]))).to_pylist()
    assert {(r["q"], r["node"]) for r in both} == {(1, 2), (1, 3)}
