"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of labelled texts. A text is lower-cased and cut into blocks,
each block is compressed with every language's dictionary, and the language with the smallest sum of sizes wins. The whole text
counts: blocks only keep a long text from becoming its own dictionary. The score is the winner's share when a size of n
bits stands for a likelihood of 2**-n, tempered by text length. A text whose runner-up is within ``min_margin`` of
the smallest size is rejected.

Fitting takes a bounded sample: at most ``pieces`` pieces of ``piece_chars`` characters for each language, one from the
middle of each chosen text. Texts are chosen by the smallest hash of the text in each of ``pieces`` hash buckets, so
every partition of the data gives the same sample. At most ``max_languages`` languages are learned; more raise an error.

Nulls: a null text, or one without a letter, is ``und`` with score 0 and is rejected. Rows with a null language teach
nothing. Without anything learned every text is ``und``. Ties go to the
language with more labelled rows, then to the one that sorts first. Repeated rows
each come back; repeated texts teach once. Columns other than those named are passed on unread; one that has a result's
name gives way to the result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, ship, sliced

PIECES = 256
PIECE_CHARS = 1024
BLOCK_BYTES = 2048
MIN_MARGIN = 0.002
MAX_LANGUAGES = 500
UNKNOWN = "und"
#: A search that finds matches of three bytes, in a window that holds a dictionary and a block.
SEARCH = {"strategy": zstd.STRATEGY_GREEDY, "min_match": 3, "search_log": 4, "window_log": 19, "hash_log": 17, "chain_log": 18, "target_length": 32}


def fit(df: DataFrame, text: str = "text", lang: str = "lang", pieces: int = PIECES, piece_chars: int = PIECE_CHARS, max_languages: int = MAX_LANGUAGES) -> dict[str, bytes]:
    """A dictionary for each language, from a bounded sample of labelled rows; languages of more rows first."""
    h = F.xxhash64(F.col(text))
    labelled = df.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), h.alias("h"))
    least = labelled.groupBy("lang", F.pmod("h", F.lit(pieces)).alias("bucket")).agg(F.min("h").alias("h"), F.count("*").alias("n"))
    chosen = least.limit(pieces * max_languages + 1).collect()
    if len({r["lang"] for r in chosen}) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not chosen:
        return {}
    wanted = df.sparkSession.createDataFrame([(r["lang"], r["h"]) for r in chosen], "lang string, h long")
    n = F.length("text")
    piece = F.substring(F.col("text"), F.greatest(F.lit(1), ((n - piece_chars) / 2).cast("int")), F.lit(piece_chars))
    found = labelled.join(F.broadcast(wanted), ["lang", "h"]).select("lang", "h", piece.alias("piece")).distinct().collect()
    rows = Counter()
    for r in chosen:
        rows[r["lang"]] += r["n"]
    by_lang: dict[str, dict[int, str]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["h"], r["piece"])):
        by_lang.setdefault(r["lang"], {}).setdefault(r["h"], r["piece"])
    return {k: "\n".join(own.values()).lower().encode() for k, own in sorted(by_lang.items(), key=lambda x: (-rows[x[0]], x[0]))}


class Classifier:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], block_bytes: int = BLOCK_BYTES, min_margin: float = MIN_MARGIN):
        self.block_bytes, self.min_margin = block_bytes, min_margin
        self.languages = list(dictionaries)
        self.compress = []
        how = zstd.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **SEARCH)
        for k in self.languages:
            raw = zstd.ZstdCompressionDict(dictionaries[k], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=how)
            self.compress.append(zstd.ZstdCompressor(dict_data=raw, compression_params=how).compress)

    def sizes(self, data: bytes) -> list[int]:
        step = self.block_bytes
        blocks = [data] if len(data) <= step else [data[i : i + step] for i in range(0, len(data), step)]
        return [sum(map(len, map(compress, blocks))) for compress in self.compress]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text.lower().encode("utf-8", "surrogatepass"))
        best = min(sizes)
        # bits grow with the text, and so would the odds: a hundredth of the size is a factor of e
        unit = max(1.0, best / 100)
        score = 1 / math.fsum(math.exp((best - s) / unit) for s in sizes)
        rest = sorted(sizes)[1:2]
        return self.languages[sizes.index(best)], score, bool(rest) and rest[0] - best < self.min_margin * best


def identify(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected"), **how) -> DataFrame:
    """df with three columns more: language, score and rejected, in place of any of those names."""
    ship(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(dictionaries)
    columns = [c for c in df.columns if c not in names]
    passed = [df.schema[c] for c in columns]
    chosen = df.select(*columns, F.col(text).alias(fresh(columns, "text")[0]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(model.value, **how)
        for batch in sliced(batches):
            rows = [classifier.predict(t) for t in batch.column(len(columns)).to_pylist()]
            more = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*columns, *names])

    added = [T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)]
    return chosen.mapInArrow(scan, T.StructType([*passed, *added]))


def keep_identified(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", **how) -> DataFrame:
    """df's rows whose text isn't rejected, unchanged."""
    ship(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(dictionaries)
    at = df.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(model.value, **how)
        for batch in sliced(batches):
            yield batch.filter(pa.array([not classifier.predict(t)[2] for t in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(scan, df.schema)
