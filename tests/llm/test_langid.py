import math
import re

import zstandard
from pyspark.sql import functions as F

from kairoline.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries.op3_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rate = got.where("held_out AND lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert rate > 0.95
    assert got.where("score < 0 OR score > 1").count() == 0


def test_odd_rows(odd, empty):
    model = langid.fit(odd)
    assert set(model) == {"en", "de"}
    got = langid.identify(odd.select("doc_id", "text"), model).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    for i in (3, 4, 5):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[1].lang_pred == "en" and by[6].lang_pred == "de"
    assert langid.fit(empty) == {} and langid.identify(odd, {}, names=("a", "b", "c")).where("a <> 'und'").count() == 0
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.where("doc_id IN (3, 4, 5)").count() == 0 and kept.where("doc_id = 2").count() == 2


def test_fit_does_not_depend_on_partitions(odd):
    assert langid.fit(odd.repartition(5)) == langid.fit(odd.coalesce(1))


def test_blocks_make_up_the_whole_text():
    c = langid.Classifier({"a": b"lorem ipsum dolor " * 20, "b": b"zwei drei vier " * 20})
    data = b"lorem ipsum " * 1000
    whole = c.sizes(data)
    assert whole == [sum(x) for x in zip(*(c.sizes(data[i : i + langid.BLOCK_BYTES]) for i in range(0, len(data), langid.BLOCK_BYTES)), strict=True)]
    assert c.predict("lorem ipsum dolor lorem ipsum")[0] == "a"
    assert langid.Classifier({"a": b"xyz", "b": b"xyz"}).predict("hello there")[2]


def test_against_a_plain_classifier(spark):
    """Every document of a table, compressed anew with each dictionary by a compressor of its own."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs.where("crc32(cast(doc_id AS string)) % 4 <> 2"))
    how = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **langid.SEARCH)

    def size(block, raw):
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress(block))

    def plain(text):
        if not text or not re.search(r"[^\W\d_]", text):
            return "und", 0.0, True
        data = text.lower().encode()
        sizes = {k: sum(size(data[i : i + langid.BLOCK_BYTES], raw) for i in range(0, len(data), langid.BLOCK_BYTES)) for k, raw in model.items()}
        best = min(sizes, key=sizes.get)
        others = [v for k, v in sizes.items() if k != best]
        odds = [math.exp(-100 * (v - sizes[best]) / max(100, sizes[best])) for v in others]
        return best, 1 / (1 + sum(odds)), min(others) - sizes[best] < langid.MIN_MARGIN * sizes[best]

    got = langid.identify(docs, model).select("text", "lang_pred", "score", "rejected").collect()
    assert len(got) == docs.count() and len(model) == 4
    for r in got:
        lang, score, rejected = plain(r.text)
        assert (r.lang_pred, r.rejected) == (lang, rejected) and abs(r.score - score) < 1e-9
    assert {r.rejected for r in got} == {True, False}


def test_columns_named_like_results(odd):
    df = odd.withColumn("rejected", F.lit(1)).withColumn("lang_pred", F.lit(2))
    got = langid.identify(df, langid.fit(odd))
    assert sorted(got.columns) == sorted({*odd.columns, "lang_pred", "score", "rejected"}) and dict(got.dtypes)["rejected"] == "boolean"
    assert got.where("doc_id = 1").first().score > 0.5
