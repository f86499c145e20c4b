import threading

import pytest

from kairoline.functions import easing as E
from kairoline.jobs import Jobs
from kairoline.operators import params as P


@pytest.mark.parametrize("kind", ["linear", "ease_in", "ease_out", "ease_in_out", "snappy"])
def test_parts_of_easings(kind):
    for a, b in ((0.0, 0.4), (0.3, 0.9), (0.55, 1.0)):
        part, points = E.subsegment(kind, a, b)
        fa, fb = E.value_at(kind, a), E.value_at(kind, b)
        for k in range(11):
            u = k / 10
            assert E.value_at(part, u, points) == pytest.approx((E.value_at(kind, a + (b - a) * u) - fa) / (fb - fa), abs=1e-6)
    with pytest.raises(ValueError):
        E.subsegment(kind, 0.5, 0.5)


def test_split_curve_keeps_its_shape(spark):
    rows = [("a", 0, 1.0, "ease_in"), ("a", 400, 3.0, "ease_in_out"), ("a", 1000, 0.5, "linear"), ("b", 500, 2.0, "linear")]
    k = spark.createDataFrame(rows, "param_id string, tick long, value double, easing string")
    out = P.split_curves(k, spark.createDataFrame([("a", 0.6), ("b", 0.25)], "param_id string, place double")).collect()
    parts = {}
    for r in sorted(out, key=lambda r: (r.param_id, r.part, r.tick)):
        parts.setdefault((r.param_id, r.part), []).append(r)
    assert [r.tick for r in parts["a", 0]] == [0, 667, 1000] and [r.tick for r in parts["a", 1]] == [0, 1000]
    assert parts["a", 0][-1].value == pytest.approx(parts["a", 1][0].value)

    def at(rows_, x):
        for p, q in zip(rows_, rows_[1:], strict=False):
            if p.tick <= x <= q.tick:
                return p.value + (q.value - p.value) * E.value_at(p.easing, (x - p.tick) / (q.tick - p.tick), p.points)

    whole = [type("R", (), dict(tick=t, value=v, easing=e, points=None)) for _, t, v, e in rows[:3]]
    for x in range(0, 1001, 50):
        assert at(parts["a", 1], x) == pytest.approx(at(whole, 600 + x * 0.4), abs=1e-6)
    assert {r.value for r in parts["b", 0] + parts["b", 1]} == {2.0}


def test_jobs(spark):
    jobs = Jobs(spark)
    done = jobs.start("count", lambda job: spark.range(1000).count())
    assert jobs.wait(done.number, 60).state == "done" and done.result == 1000
    failed = jobs.start("bad", lambda job: 1 / 0)
    assert jobs.wait(failed.number, 60).state == "failed" and "zero" in failed.error
    ready, go = threading.Event(), threading.Event()

    def slow(job):
        ready.set()
        go.wait(30)
        job.check(0.5)

    stopped = jobs.start("slow", slow)
    ready.wait(30)
    assert jobs.cancel(stopped.number)
    go.set()
    assert jobs.wait(stopped.number, 60).state == "cancelled" and not jobs.cancel(stopped.number)
    past, go2 = threading.Event(), threading.Event()

    def commits(job):
        job.commit()
        past.set()
        go2.wait(30)
        return "kept"

    kept = jobs.start("commit", commits)
    past.wait(30)
    assert not jobs.cancel(kept.number)
    go2.set()
    assert jobs.wait(kept.number, 60).result == "kept"
    assert [j.title for j in jobs.list()[0]] == ["commit", "slow", "bad", "count"] and jobs.list(2)[1]


def test_curves_are_cut_in_batches_and_arcs_without_repeats(spark):
    import math

    from pyspark.sql import functions as F

    from kairoline.functions import easing as E

    k = spark.range(400).select(F.col("id").alias("param_id"), F.explode(F.array(F.lit(100).cast("long"), F.lit(900).cast("long"))).alias("tick")).select("*", (F.col("tick") / 100.0).alias("value"), F.lit("linear").alias("easing"))
    parts = P.split_curves(k, k.select("param_id").distinct().withColumn("place", F.lit(0.5)))
    assert "InPandas" not in parts._jdf.queryExecution().executedPlan().toString()
    got = parts.groupBy("part", "tick", "value").count().collect()
    assert {(r.part, r.tick, r["count"]) for r in got} == {(0, 0, 400), (0, 200, 400), (0, 1000, 400), (1, 0, 400), (1, 800, 400), (1, 1000, 400)}
    assert {r.value for r in got if (r.part, r.tick) in ((0, 1000), (1, 0))} == {5.0}
    t = E.arc_table(F.col("corner"), F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(0.0)))
    assert str(t).count("corner") <= 2
    length = spark.range(1).select(F.array(F.lit(0.0), F.lit(0.0)).alias("corner")).select(t.alias("t")).first()["t"]
    assert len(length) == 17 and length[0] == 0.0 and math.isclose(length[8], 1.5) and math.isclose(length[16], 3.0)


@pytest.mark.parametrize("n", [1, 2, 7, 64])
def test_strips_of_times(spark, n):
    """keyframes give the times up to the next one: what sampling each time gives, without sorting times."""
    import random

    from pyspark.sql import functions as F

    from kairoline.operators import introspect, params

    rng = random.Random(n)
    keys = [(p, t, float(rng.randrange(-50, 50)), rng.choice(["linear", "ease_in", "ease_out", "ease_in_out", "hold"])) for p in range(6) for t in rng.sample(range(100), 1 + 3 * p)]
    spans = [(p, a, b) for p, a, b in [(0, 5.0, 5.0), (1, 0.0, 99.0), (2, -20.0, 130.0), (3, 90.0, 3.0), (4, 40.0, 41.0), (5, 200.0, 300.0), (9, 0.0, 1.0)]]
    k = spark.createDataFrame(keys, "param_id int, tick long, value double, easing string")
    s = spark.createDataFrame(spans, "param_id int, a double, b double")
    at = s.select("param_id", F.posexplode(introspect.strip_times(F.col("a"), F.col("b"), n)).alias("i", "t"))
    want = {(r.param_id, r.i): (r.t, r.value) for r in params.sample(k, at).collect() if r.value is not None}
    out = params.sample_strip(k, s, n)
    got = [((r.param_id, r.i), (r.t, r.value)) for r in out.collect()]
    assert len(got) == len(want) == 6 * n and all(want[key][0] == t and abs(want[key][1] - v) < 1e-12 for key, (t, v) in got)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Sort ")
