from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from kairoline.llm import decontaminate, langid, mixing, pii, simhash, substrings  # noqa: F401

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "personal_data", "mix"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.columns[:5] == docs.columns and (i == len(names) - 1 or out.columns == docs.columns)
        out.write.parquet(f"{tmp_path}/{i}")
        kept = spark.read.parquet(f"{tmp_path}/{i}")
        if name == "near_duplicates":
            found = simhash.near_duplicates(docs)
            assert kept.count() == found.select("component_id").distinct().count() == kept.select("doc_id").distinct().count()
        elif name == "decontamination":
            report = decontaminate.contamination_report(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert kept.count() == report.where("NOT contaminated").count() < docs.count()
        elif name == "personal_data":
            assert kept.count() == docs.count() and pii.find_pii(kept).where("spans <> ''").count() == 0
        elif name == "mix":
            plan = mixing.mix(docs)
            assert kept.count() == plan.selectExpr("sum(copies)").first()[0]
        else:
            assert 0.98 * docs.count() < kept.count() < docs.count()
        docs = kept


def test_run_twice_gives_the_same(spark):
    key = lambda: sorted((r.doc_id, r["copy"]) for r in corpus_pipeline.run(spark, SF).select("doc_id", "copy").collect())
    assert key() == key()


def test_empty_documents(spark, empty, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path))
    assert out.count() == 0


EXTRA = "score cut full s copy _copies copies _h _k h k _dirty dirty digest held_out lang_pred rejected fp anchor rule".split()


def test_odd_rows_and_columns_of_any_name(spark, odd, tmp_path):
    df = odd.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(i).alias(n) for i, n in enumerate(EXTRA)))
    bench = [(1, "the lazy dog and runs away from it all"), (None, "nothing of that kind"), (3, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {
        # texts that aren't null or blank; the first three rows have one text; two texts are contaminated
        "language": [1, 2, 2, 6, None],
        "near_duplicates": [1, 3, 6, None],
        "decontamination": [3, 4, 5, 6, None],
        "personal_data": [1, 2, 2, 3, 4, 5, 6, None],
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        rows = out.collect()
        if name == "mix":
            assert sorted(out.columns) == sorted(df.columns) and {r["copy"] for r in rows} <= {1, 2, 3}
            planned = Counter()
            for r in mixing.mix(odd).collect():
                planned[r.doc_id] += r.copies
            assert +planned == Counter(r.doc_id for r in rows)
        else:
            assert out.columns == df.columns
            assert sorted((r.doc_id for r in rows), key=str) == sorted(want[name], key=str)
        assert all(r[n] == i for r in rows for i, n in enumerate(EXTRA) if n != "copy")
