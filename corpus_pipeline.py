"""A corpus pipeline: language, near-duplicates, benchmark passages, personal data, then the mix of sources.

Each stage takes what the stage before kept, as written to Parquet and read again. All but the last return the columns
of documents; the last adds ``copy``, the number of a row's copy in the mix.

Every stage takes empty tables, nulls in any column, texts of any length and repeated rows, and passes on columns beyond
those of documents, whatever their names; only a column ``copy`` gives way to the mix's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoline.llm import decontaminate, langid, mixing, pii, simhash
from kairoline.llm.common import Scratch, crc_mod, read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart with enough margin; a quarter of the labels is held out of training.

    Texts that are null, empty or without a letter go. Repeated rows all stay or go; where two languages tie, the margin is
    too small and the text goes. Without any label everything goes, as nothing is told apart."""
    model = langid.fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    return langid.keep_identified(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest doc_id; a null doc_id stays only where the
    group has no other.

    Null, empty and blank texts are one group. Of several texts with the smallest doc_id one stays, of repeated rows too."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, or with too little of them to count.

    Null and empty texts have no passage and stay. Rows of one text all stay or go, whatever their doc_id."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars follows.

    Null and empty texts stay as they are (n_chars is null for a null text). Rows are independent."""
    return pii.redact_pii(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source. Null and empty texts have size 0 and are taken as their hash says. Rows of one doc_id
    (null counts as the empty one) are taken together."""
    return mixing.take(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("mix", mix)]

#: Compression and learned dictionaries have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else scratch.write(docs), sf_dir)
    return docs
