"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host and a path, such as ``example.net/en/``; ``*`` in the path stands for any characters. It fits its
host and all subdomains where the URL's path starts with the rule's. Of the fitting rules the longest wins; of equally
long ones the one that sorts first.

The index holds each rule under one literal token of its text, the one that the fewest rules have. A URL's own
tokens fetch the candidate rules, and only those run a regular expression. The index lies in one of two places, and
built-in expressions alone read it:

* in the plan, up to ``max_literal_bytes`` of rules: a constant array of hash slots. Each token of a URL looks into its own
  slot, and each row finds its verdict without a shuffle;
* in a table beyond: distinct hosts and paths are exploded to tokens and joined with the index on the token. A token that
  many URLs share ("com") is seldom any rule's rarest; AQE splits skewed partitions.

A rule's host counts whatever the case of A-Z in it; its path counts as written. ``*`` in a path spans line ends.

Nulls: a null URL, or one without ``://``, has an empty host and path, and no rule fits it. Repeated rows each keep
their verdict. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii

_TOKEN = r"[a-z0-9]+"
_ENTRY = T.StructType([T.StructField(n, T.IntegerType() if n == "n" else T.StringType()) for n in ("token", "n", "rule", "verdict", "regex")])
#: Bytes of rules, as JSON, that may be a constant of the plan.
MAX_LITERAL_BYTES = 4 << 20


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@dataclass(frozen=True)
class Rule:
    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0].translate(_LOWER)

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2] if "/" in self.pattern else ""

    def regex(self) -> str:
        """Over host and path put together: the whole host, or what follows one of its dots."""
        literal = "[^/]*".join(map(_quoted, self.host.split("*"))) + ".*".join(map(_quoted, self.path.split("*")))
        return rf"(?s)\A(?:[^/]*\.)?{literal}" + ("" if self.path else r"(?:/|\z)")

    def tokens(self) -> list[str]:
        """The tokens that any fitting URL has whole: not those that a rule's path or a star may cut short."""
        parts = re.findall(rf"{_TOKEN}|\*|[^*]", self.host + self.path, re.S)
        whole = [t for i, t in enumerate(parts) if re.fullmatch(_TOKEN, t) and (i + 1 < len(parts) and parts[i + 1] != "*") and (i == 0 or parts[i - 1] != "*")]
        return whole or ([parts[-1]] if not self.path and parts and re.fullmatch(_TOKEN, parts[-1]) else [])


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def build_index(rules: list[Rule]) -> dict[str, list[Rule]]:
    """Each rule under its rarest token, "" for rules that have none; every URL looks those up too."""
    seen = Counter(t for r in rules for t in set(r.tokens()))
    index: dict[str, list[Rule]] = {}
    for r in rules:
        rarest = min(r.tokens(), key=lambda t: (seen[t], -len(t), t), default="")
        index.setdefault(rarest, []).append(r)
    return index


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.concat(F.regexp_extract_all(F.concat(host, path), F.lit(f"({_TOKEN})"), F.lit(1)), F.array(F.lit(""))))


def _entries(rules: list[Rule]) -> list[tuple[str, int, str, str, str]]:
    """token, minus the length, rule, verdict and expression of each rule, by its token."""
    return [(token, -len(r.pattern), r.pattern, r.verdict, r.regex()) for token, own in build_index(rules).items() for r in own]


def judge_urls(df: DataFrame, rules: list[Rule], url: str = "url", key: str = "page_id", default: str = "allow", max_literal_bytes: int = MAX_LITERAL_BYTES) -> DataFrame:
    """key, host, path, the winning rule (or null) and the verdict (the rule's, or ``default``) of every row."""
    judged = df.select(F.col(key), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    slots = _slots(_entries(rules))
    if len(slots) <= max_literal_bytes:
        return _by_slot(judged, slots, key, default)
    return _by_join(judged, rules, key, default)


def _slots(entries: list[tuple]) -> str:
    """The index as a hash table in JSON: a power of two of slots, each a list of entries."""
    n = 1 << max(0, (2 * len(entries) - 1).bit_length())
    slots: list[list[dict]] = [[] for _ in range(n)]
    for e in entries:
        slots[xxhash.xxh64_intdigest(e[0], 42) % n].append(dict(zip(_ENTRY.names, e, strict=True)))
    return json.dumps({"n": n, "slots": slots})


def _by_slot(judged: DataFrame, slots: str, key: str, default: str) -> DataFrame:
    # the text is a literal, so Spark parses it once, when it plans
    table = F.from_json(F.lit(slots), T.StructType([T.StructField("slots", T.ArrayType(T.ArrayType(_ENTRY)))]))["slots"]
    n = json.loads(slots)["n"]
    own = lambda t: F.filter(F.get(table, F.pmod(F.xxhash64(t), F.lit(n)).cast("int")), lambda r: r["token"] == t)
    candidates = F.flatten(F.transform(_url_tokens(F.col("host"), F.col("path")), own))
    fitting = F.filter(candidates, lambda r: F.rlike(F.concat("host", "path"), r["regex"]))
    best = F.array_min(F.transform(fitting, lambda r: F.struct(r["n"].alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return judged.withColumn("_best", best).select(key, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def _by_join(judged: DataFrame, rules: list[Rule], key: str, default: str) -> DataFrame:
    index = judged.sparkSession.createDataFrame(_entries(rules), _ENTRY)
    sites = judged.select("host", "path").distinct()
    found = (
        sites.select("host", "path", F.explode(_url_tokens(F.col("host"), F.col("path"))).alias("token"))
        .join(index, "token")
        .where(F.expr("rlike(concat(host, path), regex)"))
        .groupBy("host", "path")
        .agg(F.min(F.struct("n", "rule", "verdict")).alias("_best"))
    )
    return judged.join(found, ["host", "path"], "left").select(key, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
