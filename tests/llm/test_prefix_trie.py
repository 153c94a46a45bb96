"""The prefix trie against a plain walk over all prefixes."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from strainlens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def plain_trie(rows):
    words = lambda x: len(re.findall(r"[^\x20\t-\r]+", x))
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn, role or "", text or ""))
    for c, turns in own.items():
        turns.sort(key=lambda x: (x[0], x[1] or 0, x[2].encode(), hashlib.md5(x[3].encode()).hexdigest()))
        own[c] = [x[2:] for x in turns]
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - int(c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(first, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[x] for x in children[path]) or 1
        saved[path] = sum(saved[x] for x in children[path]) + (len(members[path]) - 1) * (words(path[-1][1]) if path else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c in m if built[c] == p))).encode()).hexdigest())
        for p, m in members.items())


def rows_of(spark, rows):
    return sorted(tuple(r) for r in prefix_trie.trie(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)).collect())


def key(row):
    return tuple((x is not None, x) for x in row)


def test_trie_agrees_with_a_plain_walk(spark):
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(["a b", "c", "", "d\te f"])) for c in [*range(0, 130), -3, -25, 10**17] for t in range(r.randrange(1, 6)) if c % 20 or c % 40]
    # copies, a conversation that only begins like another one, nulls, ties, repeated rows
    rows += [(c, t, "user", f"same {t}") for c in range(400, 440) for t in range(4 if c % 3 else 6)]
    rows += [(500, None, "user", "early"), (500, 1, None, None), (500, 1, None, None), (500, 1, "user", "tie one"), (500, 1, "user", "tie two"), (None, 1, "user", "of none")]
    assert sorted(rows_of(spark, rows), key=key) == sorted(plain_trie(rows), key=key)


def test_long_conversations_cross_runs(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN_BITS", 2)
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 1)
    rows = [(c, 3 * t, "user", f"turn {t if t < cut else (t, c)}") for c, cut in ((0, 99), (1, 40), (2, 41), (7, 99)) for t in range(60)]
    rows += [(c, t, "user", "one of many") for c in range(20, 60) for t in range(2)]
    assert sorted(rows_of(spark, rows), key=key) == sorted(plain_trie(rows), key=key)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_without_conversations_there_is_no_node(spark, rows):
    assert rows_of(spark, rows) == []


def test_a_conversation_may_lose_all_turns(spark):
    # 1 takes three turns of 0, which is absent, and has only two of its own
    lost = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lost, 0, "user", "a"), (lost, 1, "user", "b")]
    assert rows_of(spark, rows) == plain_trie(rows) == [(lost, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())]
