"""The prefix trie of conversations against a plain one."""

import hashlib
import math
import random
import re
import zlib

import pytest

from mrkit.llm.conversation_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, rid long"


def rebuild(rows):
    turns = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [t[2:] for t in sorted(found)] for conv, found in turns.items()}
    heads = lambda conv: zlib.crc32(str(conv).encode()) % 4
    return {c: own.get(c - int(math.fmod(c, 20)), [])[: heads(c)] + own[c][heads(c) :] for c in own}


def brute_force(rows):
    convs = rebuild(rows)
    members = {}
    for conv, turns in convs.items():
        for depth in range(len(turns) + 1):
            members.setdefault(tuple(turns[:depth]), []).append(conv)
    words = lambda path: len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
    result = []
    for path, own in members.items():
        subtree = [p for p in members if p[: len(path)] == path]
        children = [p for p in subtree if len(p) == len(path) + 1]
        leaves = sum(not any(q[:-1] == p for q in members if q) for p in subtree)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(path))
        result.append((
            min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(children), leaves,
            sum((len(members[p]) - 1) * words(p) for p in subtree), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(result)


def found(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, conversation_trie(df, **sizes).collect()))


def conversations(seed, n, deepest, kinds):
    """Conversations that share much: turns of few kinds, copies of others, and some that go on where others end."""
    rng, made, rows = random.Random(seed), [], []
    for conv in range(n):
        turns = [rng.randrange(kinds) for _ in range(rng.randrange(deepest + 1))]
        if made and rng.random() < 0.5:
            other = rng.choice(made)
            turns = other[: rng.randrange(len(other) + 1)] + turns[: rng.randrange(3)] if rng.random() < 0.7 else other
        made.append(turns)
        number = rng.choice([conv, conv, 20 * conv, 3 * conv + 40])
        if any(r[0] == number for r in rows):
            continue
        for i, t in enumerate(turns):
            rows.append((number, i, ["user", "assistant", None][t % 3], [None, "", "one", "two words"][t % 4] if t < 4 else f"w{t} " * (t % 5)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{}, {"width": 2}, {"shard_rows": 4}, {"width": 3, "shard_rows": 4}])
@pytest.mark.parametrize("seed", range(3))
def test_any_conversations(spark, seed, sizes):
    rows = conversations(seed, 60, 9, 3)
    assert found(spark, rows, **sizes) == brute_force(rows)


def test_awkward_rows(spark):
    rows = [
        (None, 0, "user", "belongs to nobody"),
        (0, None, "user", "comes first"), (0, 1, None, "a b"), (0, -5, "user", None), (0, 2, "user", "a\x1cb  c\n d"),
        (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 1, "user", "x"),
        (25, 3, "user", "its base is not there"), (-7, 0, "user", "negative"), (-20, 0, "user", "negative base"),
        (45, 0, "us", "er"), (46, 0, "user", ""), (47, 0, "1:", "u"), (48, 0, "", "1:u"),
        (60, 0, "user", "same"), (61, 0, "user", "same"), (62, 0, "user", "same"), (63, 0, "user", "same"),
        (9, 0, "user", "word " * 50_000),
    ]
    for sizes in ({}, {"width": 1, "shard_rows": 4}):
        assert found(spark, rows, **sizes) == brute_force(rows)
    assert found(spark, rows[:1]) == [] == found(spark, [])


def test_one_long_conversation_and_its_copies(spark):
    """Chains are not unrolled level by level: far more segments than levels could be run in the time of a test."""
    long = [("user", f"turn {i}") for i in range(600)]
    rows = [(c, i, *t) for c in (100, 120, 140) for i, t in enumerate(long)]
    rows += [(160, i, *t) for i, t in enumerate(long[:7])] + [(180, i, *t) for i, t in enumerate(long[:4])]
    result = found(spark, rows, width=2, shard_rows=4)
    by_depth = {r[1]: r for r in result}
    assert len(result) == 601 and by_depth[0] == (100, 0, None, 5, 1, 1, by_depth[0][6], hashlib.sha256(b"").hexdigest())
    assert by_depth[600][2:] == (100, 3, 0, 1, 4, hashlib.sha256(b"100,120,140").hexdigest())
    assert by_depth[0][6] == sum(2 * (4 * (i <= 4) + 3 * (4 < i <= 7) + 2 * (i > 7)) for i in range(1, 601))


def test_many_conversations_of_equal_turns(spark):
    """Ids of a third of all conversations are hashed in their order, in many chunks."""
    n = 30_000
    rows = [(20 * c, 0, "user", "hello") for c in range(n)] + [(20 * c, 0, "user", f"hello {c}") for c in range(n, 3 * n)]
    result = {r[:2]: r for r in found(spark, rows, shard_rows=1000)}
    assert len(result) == 2 * n + 2 and result[0, 0][3:6] == (3 * n, 2 * n + 1, 2 * n + 1)
    ids = ",".join(str(20 * c) for c in range(n))
    assert result[0, 1][3:] == (n, 0, 1, n - 1, hashlib.sha256(ids.encode()).hexdigest())
