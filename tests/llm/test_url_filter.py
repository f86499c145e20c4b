import random
import re

import pytest

from kairoline.llm import url_filter as U
from kairoline.llm.queries import RULES

URLS = [
    ("http://www.Example.net/en/a?x=1", "www.example.net", "/en/a", "example.net/en/", "allow"),
    ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
    ("https://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
    ("https://a.b.example.com/de/1#f", "a.b.example.com", "/de/1", "example.com/de/", "block"),
    ("ftp://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
    ("http://x.net", "x.net", "", None, "allow"),
    ("http://net/?q", "net", "/", "net/", "block"),
    ("no scheme.net/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://É.NET/É", "É.net", "/É", "net/", "block"),
    ("x" * 50_000 + "://y.net/" + "z" * 50_000, "y.net", "/" + "z" * 50_000, "net/", "block"),
]


@pytest.mark.parametrize("literal", [U.MAX_LITERAL_BYTES, 0])
def test_contract_rules(spark, literal):
    rows = [(i, u, "own", "own") for i, (u, *_) in enumerate(URLS)] * 2 + [(None, "http://a.net/", "r", "v")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, host string")
    got = sorted(U.judge_urls(df, RULES, max_literal_bytes=literal).collect(), key=str)
    want = [(i, *w) for i, (_, *w) in enumerate(URLS)] * 2 + [(None, "a.net", "/", "net/", "block")]
    assert got == sorted(map(tuple, want), key=str) or sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_index_holds_each_rule_once_under_its_rarest_token():
    rules = [U.Rule(p, "block") for p in ("ads.com/", "ads.com/x/", "ads.net/", "com/*/track/", "com")]
    index = U.build_index(rules)
    assert sorted(r.pattern for own in index.values() for r in own) == sorted(r.pattern for r in rules)
    assert [r.pattern for r in index["net"]] == ["ads.net/"]
    assert [r.pattern for r in index["track"]] == ["com/*/track/"]


def test_wildcards(spark):
    df = spark.createDataFrame([(1, "http://a.com/q/track/1"), (2, "http://a.com/track/1"), (3, "http://b.com")], "page_id long, url string")
    got = {r.page_id: r.rule for r in U.judge_urls(df, [U.Rule("com/*/track/", "block"), U.Rule("b.com", "block")]).collect()}
    assert got == {1: "com/*/track/", 2: None, 3: "b.com"}


@pytest.mark.parametrize("literal", [U.MAX_LITERAL_BYTES, 0])
def test_many_rules_against_each_rule_on_each_url(spark, literal):
    rng = random.Random(2)
    word = lambda: rng.choice(["ads", "a", "track", "x1", "Net", "com", "shop"])
    rules = list({p: U.Rule(p, rng.choice(["block", "allow"])) for p in (f"{'.'.join(word() for _ in range(rng.randint(1, 2)))}{rng.choice(['', '/', f'/{word()}', f'/*/{word()}/', f'/{word()}/{word()}'])}" for _ in range(700))}.values())
    urls = [f"http://{'.'.join(word() for _ in range(rng.randint(1, 3)))}/{'/'.join(word() for _ in range(rng.randint(0, 3)))}{rng.choice(['', '/', chr(10) + 'track/'])}" for _ in range(200)]

    def judged(url):
        host, _, path = url[7:].partition("/")
        site = host.lower() + "/" + path
        fits = [(-len(r.pattern), r.pattern) for r in rules if re.search(r.regex().replace(r"\z", r"\Z"), site)]
        return min(fits, default=(0, None))[1]

    assert len(rules) > 200 and any("Net" in r.host or "net" in r.host for r in rules)
    got = U.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, max_literal_bytes=literal).collect()
    assert {r.page_id: r.rule for r in got} == {i: judged(u) for i, u in enumerate(urls)}
    assert sum(r.rule is None for r in got) < 150


def test_case_of_hosts_and_line_ends(spark):
    df = spark.createDataFrame([(1, "http://x.ADS.com/a"), (2, "http://ads.com/q\n/track/")], "page_id long, url string")
    got = {r.page_id: r.rule for r in U.judge_urls(df, [U.Rule("Ads.com/", "block"), U.Rule("com/*/track/", "block")]).collect()}
    assert got == {1: "Ads.com/", 2: "com/*/track/"}


def test_only_built_in_expressions(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    for literal in (U.MAX_LITERAL_BYTES, 0):
        plan = U.judge_urls(df, RULES, max_literal_bytes=literal)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
