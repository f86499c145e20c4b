import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import time
import zlib
from urllib.parse import quote

import pytest
import zstandard

from kairoline.llm import secrets

SECRET = "password=hunter2hunter2x"
PATTERNS = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
]


def brute(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, good) in enumerate(PATTERNS) for m in re.finditer(p, text) if good(m)]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def test_base_matches_are_those_of_the_patterns():
    rng = random.Random(3)
    parts = ["password", "PassWD", "ſecret", "secret", "toKen", "api_key", "apikey", "AKIA", "=", ":", " ", '"', "'", "a1b2c3", "ABCDEF12", "x/y+z", "-", "é", "%41", "\\u0041", "\n"]
    seen = 0
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        want = brute(text)
        seen += len(want)
        assert [(f.kind, f.start, f.end) for f in secrets.secrets(text)[0] if f.base] == want, text
    assert seen > 2000


def b64(data):
    return base64.b64encode(data).decode()


def percent(text):
    return "".join(f"%{b:02x}" for b in text.encode())


ENCODED = [
    (percent, "escape"),
    (lambda t: quote(t, safe=""), "escape"),
    (lambda t: "".join(f"\\u{ord(c):04x}" for c in t), "escape"),
    (lambda t: "".join(f"\\x{ord(c):02x}" for c in t), "escape"),
    (lambda t: "".join(f"\\u{{{ord(c):x}}}" for c in t), "escape"),
    (lambda t: "".join(f"&#{ord(c)};" for c in t), "escape"),
    (lambda t: "".join(f"&#x{ord(c):x};" for c in t), "escape"),
    (lambda t: percent(percent(t)), "escape>escape"),
    (lambda t: b64(t.encode()), "base64"),
    (lambda t: b64(t.encode()).rstrip("="), "base64"),
    (lambda t: b64(t.encode("utf-16-le")), "base64"),
    (lambda t: b64(b64(t.encode()).encode()), "base64>base64"),
    (lambda t: b64(gzip.compress(t.encode())), "base64>gzip"),
    (lambda t: b64(zlib.compress(t.encode())), "base64>zlib"),
    (lambda t: b64(bz2.compress(t.encode())), "base64>bzip2"),
    (lambda t: b64(lzma.compress(t.encode())), "base64>xz"),
    (lambda t: b64(zstandard.compress(t.encode())), "base64>zstd"),
    (lambda t: b64(gzip.compress(zlib.compress(t.encode()))), "base64>gzip>zlib"),
    (lambda t: b64(gzip.compress(percent(t).encode())), "base64>gzip>escape"),
    (lambda t: quote(gzip.compress(t.encode())), "url>gzip"),
    (lambda t: repr(zlib.compress(t.encode())), "escape>zlib"),
    (lambda t: percent(b64(percent(t).encode())), "escape>base64>escape"),
]


@pytest.mark.parametrize("k", range(len(ENCODED)))
def test_layers_map_back_to_the_source(k):
    encode, chain = ENCODED[k]
    hidden = encode(SECRET)
    for text in (hidden, f"é so {hidden} and on"):
        found, n, unopened = secrets.secrets(text)
        mine = [f for f in found if f.kind == "assign"]
        assert [(f.value, f.layers, f.base) for f in mine] == [(SECRET, chain, False)] and n > 1 and not unopened
        (a, b) = mine[0].start, mine[0].end
        # bytes of the source that aren't the secret's may only complete a group of base64 or a quoted literal
        assert text[a:b] in hidden and len(hidden) - (b - a) <= 7
        assert hidden not in secrets.redacted(text) and "<ASSIGN>" in secrets.redacted(text)


def test_parts_of_a_base64_run_map_to_their_characters():
    inner = f"some words {SECRET} and more"
    run = b64(inner.encode())
    for text in (run, f"host/{run}/x", "\n".join(run[i : i + 20] for i in range(0, len(run), 20))):
        (f,) = (f for f in secrets.secrets(text)[0] if f.kind == "assign")
        part = text[f.start : f.end].replace("\n", "")
        at = run.index(part)
        assert SECRET in base64.b64decode(run[at // 4 * 4 : -(-(at + len(part)) // 4) * 4]).decode() and len(part) <= len(SECRET) * 4 / 3 + 4


def test_a_longer_span_comes_beside_the_base_one():
    found, _, _ = secrets.secrets("token=abcdefghijkl%6Dnopq")
    assert [(f.start, f.end, f.base) for f in found] == [(0, 18, True), (0, 25, False)]


def test_a_secret_in_a_secrets_value():
    found, _, _ = secrets.secrets("token=" + b64(SECRET.encode()))
    assert [(f.base, f.value) for f in found if f.kind == "assign"][1:] == [(False, SECRET)]


def test_streams_that_come_again_end(monkeypatch):
    loop = {b"\x1f\x8bA": b"\x1f\x8bB", b"\x1f\x8bB": b"\x1f\x8bA"}
    monkeypatch.setattr(secrets, "_unpacked", lambda kind, data, most: loop[data])
    data, kinds = secrets._open(b"\x1f\x8bA", secrets._Budget(100))
    assert data == b"\x1f\x8bA" and kinds == ["gzip", "gzip"]


def test_streams_beyond_the_bound_are_counted():
    text = b64(gzip.compress(b"x" * 100_000 + SECRET.encode()))
    assert secrets.secrets(text, 10_000)[2] == 1 and not [f for f in secrets.secrets(text, 10_000)[0] if f.value == SECRET]
    assert secrets.secrets(text)[2] == 0 and [f for f in secrets.secrets(text)[0] if f.value == SECRET]


def test_escapes_nested_deeper_than_the_passes():
    text = SECRET
    for _ in range(60):
        text = text.replace("%", "%25").replace("\\", "%5c") if "%" in text else text.replace("=", "%3d")
    (f,) = (f for f in secrets.secrets(f"é {text}")[0] if f.kind == "assign")
    assert f.value == SECRET and (f.start, f.end) == (2, 2 + len(text)) and f.layers.count("escape") == secrets.PASSES + 1


def test_settling_is_what_the_passes_come_to():
    rng = random.Random(4)
    for _ in range(5000):
        text = "".join(rng.choice(["%", "25", "41", "\\u00", "\\x", "5c", "&#", "37;", "x25;", "\\u{", "25}", "a", "é"]) for _ in range(rng.randint(1, 12)))
        passes = text
        while (new := secrets.Rewriting(passes, list(secrets._escape_edits(passes))).text) != passes:
            passes = new
        settled = secrets._Settled(text)
        now = settled.text
        while (new := secrets.Rewriting(now, list(secrets._escape_edits(now))).text) != now:
            now = new
        assert now == passes, text
        assert all(settled.back(i, i + 1) == (a, b) for i, (a, b) in enumerate(zip(settled.starts, settled.ends, strict=True)))
        assert settled.starts[:1] in ([0], []) and settled.starts[1:] == settled.ends[:-1] and settled.ends[-1:] in ([len(text)], [])


def test_long_and_hostile_texts_take_linear_time():
    for text in ("%" + "25" * 60_000 + "41", "A" * 300_000, "0" * 300_000, "token " * 50_000, "token" + " " * 200_000, "%" * 300_000, ("QUJD" * 19 + "\n") * 4000, "&#" * 100_000, "\\u005c" * 30_000 + "u0041", "A" * 76 + ("\n" + "A" * 75) * 3000):
        began = time.time()
        secrets.secrets(text)
        assert time.time() - began < 20


@pytest.mark.parametrize("text", ["", "100% of 25% and 3%", "a\\b \\u12 &#; &# 12;", "Donaudampfschifffahrtsgesellschaft", "token ring, secret: none", "AKIA", "deadbeef"])
def test_clean_texts_have_none(text):
    assert secrets.secrets(text)[0] == [] and secrets.redacted(text) == text


def test_tables(spark, odd, empty):
    got = secrets.report(secrets.find_secrets(odd)).collect()
    assert len(got) == odd.count() and secrets.find_secrets(empty).count() == 0
    assert {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()} and {r.spans for r in got} == {""}
    text = f"{SECRET} {percent(SECRET)} 0123456789abcdef0"
    df = spark.createDataFrame([(1, text, "k"), (None, None, None), (1, text, "k")], "doc_id int, text string, found string")
    rows = secrets.report(secrets.find_secrets(df)).where("doc_id = 1").collect()
    base = f"assign:0:24,hex:{len(text) - 17}:{len(text)}"
    assert len(rows) == 2 and rows[0] == rows[1]
    assert (rows[0].n_assign, rows[0].n_access, rows[0].n_hex) == (1, 0, 1)
    assert rows[0].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert rows[0].spans == f"assign:0:24,assign:25:{25 + 3 * 24},hex:{len(text) - 17}:{len(text)}"
    clean = secrets.redact_secrets(df)
    assert clean.columns == df.columns and clean.where("doc_id = 1").first().text == "<ASSIGN> <ASSIGN> <HEX>"


def test_base_of_the_whole_table(spark):
    from kairoline.llm.queries import op11_secrets

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = op11_secrets(spark, sf).collect()
    assert len(got) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in got) > 0
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, _, _ in want) for kind in secrets.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))
