"""Operator 13 against brute force: branched, shared, hot, long and empty conversations, one and many shards."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from collinea.llm import conversation_trie as T


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    paths = {}
    for conv in turns:
        turns[conv].sort(key=lambda t: t[:3])
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - (conv % 20 if conv >= 0 else -(-conv % 20))
        paths[conv] = tuple(t[2:] for t in sorted(turns.get(base, []), key=lambda t: t[:3])[:h] + turns[conv][h:])
    members = defaultdict(list)
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved = (len(members[p]) - 1) * words + sum(out[c][6] for c in children[p])
        leaves = sum(out[c][5] for c in children[p]) or 1
        ends = ",".join(map(str, sorted(c for c in members[p] if len(paths[c]) == len(p))))
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def planted(seed):
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choice(["ça", "va", "New", "york\x0b", "é", "\t"]) for _ in range(rng.randint(0, 5)))
    hot = [(turn, rng.choice(["user", None]), text()) for turn in range(4)]
    start = [("system", "Be brief."), ("user", "Hi  there")]
    rows = [(None, 0, "user", "no conversation"), (7, None, "user", "first"), (7, None, "user", "first"), (7, 0, None, None), (-3, 1, "user", "below zero"), (-20, 1, "user", "its base")]
    for conv in range(20, 420):
        kind = rng.random()
        if kind < 0.35:  # one conversation for a third of all ids
            rows += [(conv, *t) for t in hot]
        elif kind < 0.7:  # few first turns, then few replies
            chain = [rng.choice(start), rng.choice(start), ("assistant", rng.choice(["yes", "no", ""])), *(("user", text()) for _ in range(rng.randint(0, 3)))]
            rows += [(conv, turn, *t) for turn, t in enumerate(chain[: rng.randint(1, 6)])]
        elif kind < 0.97:
            rows += [(conv, turn, rng.choice(["user", ""]), text()) for turn in range(rng.randint(1, 5))]
    rows += [(1000, turn, "user", "again") for turn in range(700)] + [(1001, turn, "user", "again") for turn in range(650)]
    rows += [(1002, 1, "user", "word " * 50_000)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn int, role string, text string, number int, path string").repartition(3)


def found(spark, rows, shards=None):
    return sorted((tuple(r) for r in T.branched_trie(frame(spark, rows), shards).collect()), key=str)


def test_equal_to_brute_force(spark):
    rows = planted(1)
    assert found(spark, rows) == brute(rows)


def test_one_and_many_shards(spark):
    rows = planted(2)
    want = brute(rows)
    assert found(spark, rows, 1) == want and found(spark, rows, 40) == want


def test_cut_splitters_and_short_stretches(spark, monkeypatch):
    rows = planted(3)
    monkeypatch.setattr(T, "SKELETON_BYTES", 300)
    assert found(spark, rows, 6) == brute(rows)


def test_turnless_and_empty(spark):
    assert found(spark, []) == []
    rows = [(21, 0, "user", "a"), (22, 0, "user", "a"), (23, 0, "user", "b"), (25, 0, None, None)]
    assert found(spark, rows) == brute(rows)


def test_shard_with_short_stretches(monkeypatch):
    monkeypatch.setattr(T, "STRETCH", 2)
    a, b = b"a" * 16, b"b" * 16
    shard = T._Shard({b"": 0, a: 1})
    for conv in range(5):
        shard.add(a, conv, [2])
    shard.add(a + b, 9, [2, 3])
    shard.add(b, 4, [1])
    shard.leave(0)
    assert [r[3] for r in shard.rows if r[0] == "ends"] == ["0,1", "2,3", "4"]
    parts = {r[1]: r[4:11] for r in shard.rows if r[0] == "part"}
    assert parts == {1: (0, 1, 2, 6, 1, 1, 0), 0: (0, 0, 0, 7, 1, 1, 0)}
