"""Prefix trie against a plain one of dictionaries."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import pytest

from tripspark.llm import prefix_trie
from tripspark.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string, td string, depth int"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    """Rebuilt conversations and their nodes, one prefix after the other."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            td = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, td, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    out = []
    for node, found in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(x[: len(m)] == m and len(x) == len(m) + 1 for x in below)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].split()) for m in below if m)
        ends = ",".join(map(str, sorted(c for c in found if len(paths[c]) == len(node))))
        above = min(members[node[:-1]]) if node else None
        out.append((min(found), len(node), above, len(found), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda x: x[:2])


def told(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=lambda x: x[:2])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("block", [1, 3, 4])
def test_equals_plain_trie(spark, block):
    rng = random.Random(block)
    rows = []
    for conv in range(70):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9, 13])):
            rows.append((conv, turn if turn else None, rng.choice(["user", "assistant", None]), rng.choice(["yes", "no it is", "", None])))
    assert told(prefix_trie.op13_prefix_trie(frame(spark, rows), block)) == plain(rows)


def test_shared_chains_ties_and_awkward_rows(spark):
    shared = [("user", "one two"), ("assistant", "three"), ("user", "four five six"), ("assistant", "x"), ("user", "y"), ("assistant", "z")]
    rows = [(c, t, *shared[t]) for c in (0, 20, 40, 60, 100) for t in range(6)]
    rows += [(60, 6, "user", "own end"), (7, 1, "user", "b"), (7, 1, "user", "a"), (7, 1, "user", "a"), (7, None, None, None)]
    rows += [(None, 0, "user", "no conversation"), (-3, 0, "user", "below zero"), (33, 0, "user", "alone"), (38, 0, "user", "shorter than h?")]
    rows += [(900, t, "user", "long " * (t % 3)) for t in range(45)] + [(901, t, "user", "long " * (t % 3)) for t in range(44)]
    rows += [(5, 0, "us", "er text"), (6, 0, "user", " text")]
    assert told(prefix_trie.op13_prefix_trie(frame(spark, rows))) == plain(rows)


def test_empty_table_has_no_node(spark):
    assert prefix_trie.op13_prefix_trie(frame(spark, [(1, 1, "a", "b")]).limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not mounted")
def test_given_conversations(spark):
    turns = table(spark, "/root/testdata/sf0.001", "conversations")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()]
    assert told(prefix_trie.op13_prefix_trie(turns)) == plain(rows)
