"""Looks' rules over values parsed once, against the rule read field by field."""

from pyspark.sql import functions as F

from kairoline.operators import look_rules as L

VALUES = ['{"brightness": 2}', '{"brightness": "0.5"}', '{"brightness": NaN}', "{'brightness': 3}", '{"brightness": 1', "[1]", "null", '"screen"', "screen", "true", '{"size": [1, 0]}', '{"size": 3}', '{"kind": "blob"}', '{"center": [11, {"a": 1}]}', '{"shadow": {"blur": -1}}', '{"shadow": 2}', '{"x": 0.6, "w": 0.6}', '{"w": true}', '{"scale_x": 1e309, "opacity": null}', "{}", None]


def test_parsed_once_is_as_read_by_field(spark):
    df = spark.createDataFrame([(i, n, v) for i, (n, v) in enumerate((n, v) for n in (*L.NAMES, "zzz") for v in VALUES)], "clip_id long, name string, value string")
    wanted = F.when(~F.col("name").isin(*L.NAMES), "unknown name")
    for n in ("adjustments", "mask", "crop", "transform", "styles", "blend", "denoise", "chroma"):
        wanted = wanted.when(F.col("name") == n, L.reason(n, F.col("value")))
    kept = df.where(F.col("name").isin("adjustments", "mask", "crop", "transform", "styles", "blend", "denoise", "chroma", "zzz"))
    want = {tuple(r) for r in kept.select("clip_id", "name", wanted.alias("reason")).where("reason IS NOT NULL").collect()}
    found = L.violations(kept.select("clip_id", F.create_map("name", "value").alias("look")))
    assert {tuple(r) for r in found.collect()} == want and len(want) > 60
    # a value is read once by its name's rules: not a field at a time in one long generated method
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "from_json" in plan
