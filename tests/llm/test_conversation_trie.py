"""Conversation trie against a plain trie in Python: shared starts, copies, proper prefixes, turnless conversations, long ones."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

import hubflow.llm.conversation_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, c string, d long, rep string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 5, "y") for r in rows], SCHEMA).repartition(parts)


def key(turn):
    role, text = turn
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def sequences(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, key((role or "", text or "")), (role or "", text or "")))
    convs = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(seqs):
    members = defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def walk(node):
        below = [walk(kid) for kid in children[node]]
        own = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        return (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + own)

    out = []
    for node, who in members.items():
        leaves, saved = walk(node)
        ends = ",".join(str(c) for c in sorted(who) if len(seqs[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def check(spark, rows):
    assert Counter(map(tuple, T.conversation_trie(table(spark, rows)).collect())) == brute(sequences(rows))


def test_random_conversations(spark):
    rng = random.Random(2)
    rows = []
    for c in [*range(95, 130), *range(-130, -95), *range(-5, 6), 200, 201, 5**20, 5**20 + 1, 2**62]:
        rows += [(c, i, "user" if i % 2 else "assistant", rng.choice(["a", "bé", "c" * 9, ""])) for i in range(rng.randrange(0, 9))]
    check(spark, rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, 0, "user", "nobody's")] * 5 + [(1, None, None, None), (1, 0, "user", None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 3, "user", "y\n\x00")]
    rows += [(2, None, "", ""), (2, 0, "user", ""), (3, 7, "use", "rx"), (3, 8, "user", "x")]
    check(spark, rows)


def test_turnless_conversations_only(spark):
    few = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1]
    check(spark, [(c, 0, "user", f"t{c}") for c in few])


def test_copies_and_proper_prefixes(spark):
    turns = [("user", f"text {i}") for i in range(12)]
    rows = [(c, i, *turns[i]) for c in range(300, 360) for i in range(12 if c % 3 else 4 + c % 7)]
    check(spark, rows)


def test_long_conversation_goes_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 16)
    rows = [(100, i, "user", str(i % 5)) for i in range(300)] + [(c, i, "user", str(i % 5)) for c in range(101, 150) for i in range(40 + c % 5)]
    rows += [(c, 0, "user", "same") for c in range(400, 470)]
    check(spark, rows)


def test_very_long_text_and_empty_table(spark):
    check(spark, [(0, 0, "user", "z" * 2_000_000), (1, 0, "user", "z" * 2_000_000), (1, 1, "a", "é" * 500_000)])
    assert T.conversation_trie(table(spark, [(1, 1, "a", "b")]).limit(0)).collect() == []


def test_node_turns(spark):
    rows = [(0, i, "user", f"w{i}") for i in range(7)] + [(1, i, "user", f"w{i}") for i in range(9)]
    seqs = sequences(rows)
    got = T.node_turns(T.conversation_trie(table(spark, rows)), table(spark, rows)).collect()
    assert len(got) == sum(brute(seqs).values())
    for r in got:
        assert (r["role"], r["text"]) == (seqs[r["conv_id"]][r["depth"] - 1] if r["depth"] else (None, None))
