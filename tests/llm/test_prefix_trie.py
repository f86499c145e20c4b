import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from kairoline.llm import prefix_trie
from kairoline.llm.common import Scratch

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(role, text) for *_, role, text in sorted(t)] for c, t in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c > 0 else -(abs(c) % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    below = {}
    for path in sorted(members, key=len, reverse=True):
        kids = [below[k] for k in children[path]]
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        below[path] = (sum(k[0] for k in kids) or 1, own + sum(k[1] for k in kids))
    return sorted(
        (min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(children[path]), *below[path], hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest())
        for path, m in members.items()
    )


def nodes(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def random_turns(rng, convs, longest, texts):
    rows = []
    for c in convs:
        for t in range(rng.randint(0, longest)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = random_turns(rng, range(-10, 40), 12, ["a", "é b", None, ""]) + [(None, 1, "user", "x")]
    rows += rows[:5]  # repeated rows are repeated turns
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert nodes(prefix_trie.conversation_trie(df)) == brute(ordered(rows))
    scratch = Scratch(spark, "t")
    assert nodes(prefix_trie.trie(*prefix_trie.branched(df, scratch), scratch)) == brute(rebuilt(ordered(rows)))


def test_prefixes_over_many_blocks(spark):
    """Copies of a long conversation that part late, one by one, and some that never do."""
    long = [("user", f"turn {i}") for i in range(700)]
    convs = {0: long, 1: long, 2: long[:300], 3: [*long[:23], ("user", "else"), *long[24:]], 4: [*long[:24], ("user", "else")], 5: long[:8], 6: [*long[:699], ("assistant", "end")], 7: long[:56], 8: [("system", "other")]}
    rows = [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert nodes(prefix_trie.conversation_trie(df)) == brute(convs)


def test_a_turn_that_most_begin_with(spark):
    rows = [(c, t, "user", "hello" if t == 0 and c % 3 else f"{c % 7} {t}" if c % 2 else f"{c} {t}") for c in range(3000) for t in range(c % 4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert nodes(prefix_trie.conversation_trie(df)) == brute(ordered(rows))


def test_one_conversation_in_many_buckets(spark):
    rng = random.Random(5)
    rows = [(c, t, "user", f"{t}") for c in (1, 2) for t in range(-900, 900)] + [(2, None, "user", "first"), (1, 5, "assistant", "tie"), (1, 5, "user", "5")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert nodes(prefix_trie.conversation_trie(df)) == brute(ordered(rows))


def test_odd_tables(spark):
    schema = "conv_id int, turn int, role string, text string, i long, label string, block int"
    assert prefix_trie.conversation_trie(spark.createDataFrame([], schema)).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", 1, "x", 1)], schema)).count() == 0
    rows = [(1, 0, None, None, 1, "x", 0), (1, 1, "user", "long " * 100_000, 1, "x", 0), (1, 1, "user", "long " * 100_000, 1, "x", 0)]
    assert nodes(prefix_trie.conversation_trie(spark.createDataFrame(rows, schema))) == brute(ordered([r[:4] for r in rows]))
