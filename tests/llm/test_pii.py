import random
import re

import pytest

from kairoline.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(int(c) for c in reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return True


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text) if valid(k, m[0])] for k, p in PATTERNS.items()}


def test_plain_spans_are_those_of_the_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@+- (5042.)") for _ in range(rng.randint(0, 40)))
        assert pii.plain_spans(text) == brute(text), text


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john dot smith at mail dot example dot com now", "email", "john dot smith at mail dot example dot com"),
        ("write to joe (at) site (dot) org please", "email", "joe (at) site (dot) org"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("j​ohn@ex​ample.com", "email", "j​ohn@ex​ample.com"),
        ("call plus one four five six five five five two one eight six", "phone", "plus one four five six five five five two one eight six"),
        ("card four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("host 192 dot 168 dot 1 dot 12", "ip", "192 dot 168 dot 1 dot 12"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    plain, spans = pii.all_spans(text)
    assert plain[kind] == []
    assert [text[a:b] for a, b in spans[kind]] == [found]
    assert found not in pii.redacted(text)


@pytest.mark.parametrize("found", ["plus 4 one 5 five 5 five 0 one 2 three", "plus one 4 one 5 five 5 five 0 one 2", "plus 4 1 five 5 5 five 0 1 two 3 4 five"])
def test_numerals_and_digit_words_in_turn(found):
    for text in (f"call {found} now", f"one two and {found} now"):
        assert [text[a:b] for a, b in pii.all_spans(text)[1]["phone"]] == [found]
        assert "<PHONE>" in pii.redacted(text)


def test_the_gate_passes_what_spelled_matches():
    rng, matched = random.Random(6), 0
    for _ in range(20_000):
        text = "".join(rng.choice(["plus", "one", "Six", "7", "42", "a", " ", " ", "-", ".", "\t", "double", "un", "Dos", " " * 70]) for _ in range(rng.randint(0, 12)))
        if pii._SPELLED.search(text):
            matched += 1
            assert pii._has_spelled(text), text
    assert matched > 500


def test_letters_that_only_fold_to_ascii_are_no_digit_words():
    for text in ("4 \u017fix \u017feven", "one s\u0130x two"):
        assert not any(pii.all_spans(text)[1].values())


@pytest.mark.parametrize("text", ["look at the tree dot and so on", "one two three", "at dot at dot", "meet me at seven", "a @ b", "née à Paris, 12 rue"])
def test_clean_texts_stay(text):
    assert not any(pii.all_spans(text)[1].values())
    assert pii.redacted(text) == text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+" * 300_000, "a@" * 150_000, "one " * 60_000, "x dot " * 50_000):
        pii.all_spans(text)


def test_a_hidden_span_in_a_long_plain_one_is_dropped():
    plain, spans = pii.all_spans("1.1.1.1_2.2.2.2_3.3.3.3_4.4.4.4_5.5.5.5@x.1.2.3.４")
    assert len(plain["email"]) == 1 and len(plain["ip"]) == 5 and spans == plain


@pytest.mark.parametrize("n", [5, 60, 20_000])
def test_long_disguised_local_parts(n):
    found = "john" + " dot smith" * n + " at mail dot example dot com"
    for text in (found, f"mail to {found} now", f"so dot, {found}. x at y"):
        assert [text[a:b] for a, b in pii.all_spans(text)[1]["email"]] == [found]


def test_table(spark, odd, empty):
    got = pii.find_pii(odd).collect()
    assert len(got) == odd.count() and pii.find_pii(empty).count() == 0
    assert {r.base_sha256 for r in got} == {"e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}
    df = spark.createDataFrame([(1, "a@b.co and 1.2.3.4", 18), (2, None, None)], "doc_id long, text string, n_chars long")
    r = {x.doc_id: x for x in pii.find_pii(df).collect()}
    assert r[1].spans == "email:0:6,ip:11:18" and (r[1].n_email, r[1].n_ip) == (1, 1) and r[2].spans == ""
    out = {x.doc_id: x for x in pii.redact_pii(df).collect()}
    assert out[1].text == "<EMAIL> and <IP>" and out[1].n_chars == 16 and out[2].text is None
    assert pii.redact_pii(odd).count() == odd.count()


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write john @ example . com now", "email", "john @ example . com"),
        ("write john.doe @ mail.example.org now", "email", "john.doe @ mail.example.org"),
        ("mail \U0001d423\U0001d428\U0001d421\U0001d427@\U0001d41e\U0001d431.com!", "email", "\U0001d423\U0001d428\U0001d421\U0001d427@\U0001d41e\U0001d431.com"),
        ("call plus one double four five double five one two triple three", "phone", "plus one double four five double five one two triple three"),
        ("host one nine two dot one six eight dot one dot nine up", "ip", "one nine two dot one six eight dot one dot nine"),
        ("ruf plus vier neun drei null eins zwei drei vier fünf sechs an", "phone", "plus vier neun drei null eins zwei drei vier fünf sechs"),
        ("tel plus trois trois un deux trois quatre cinq six sept", "phone", "plus trois trois un deux trois quatre cinq six sept"),
        ("tel plus tres cuatro uno dos tres cuatro cinco seis siete", "phone", "plus tres cuatro uno dos tres cuatro cinco seis siete"),
    ],
)
def test_further_disguises(text, kind, found):
    plain, every = pii.all_spans(text)
    assert not any(plain.values())
    assert [text[a:b] for a, b in every[kind]] == [found] and sum(map(len, every.values())) == 1


@pytest.mark.parametrize("text", ["we meet at example.com tomorrow", "one dot com, two dots", "un deux trois", "price @ 3 . 50", "a @ b", "Dos o tres. Uno, dos.", "\u2460 first \u2461 second \u2462 third"])
def test_prose_is_left_alone(text):
    plain, every = pii.all_spans(text)
    assert not any(every.values()) and pii.redacted(text) == text
