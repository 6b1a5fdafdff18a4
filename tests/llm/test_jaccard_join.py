"""Jaccard join against all pairs of sets of word tuples."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripspark.llm import jaccard_join
from tripspark.llm.common import table

SCHEMA = "doc_id long, text string, node string, n int, key long"


def plain(rows):
    """Size of the set and smallest id over links, all pairs compared."""
    spaces = "".join(map(chr, [32, *range(9, 14)]))
    sets = []
    for _, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in lowered.translate(str.maketrans(spaces, " " * 6)).split(" ") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    out = []
    for (doc_id, _), s, mark in zip(rows, sets, label, strict=True):
        ids = [r[0] for r, m in zip(rows, label, strict=True) if m == mark and r[0] is not None]
        out.append((str(doc_id), len(s), str(min(ids) if s and ids else doc_id)))
    return sorted(out)


def told(df):
    return sorted((str(r.id), r.n, str(r.component_id)) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    """Chains of edits, crowds around one text, texts that share most of a passage, and fillers."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for size in (12, 40, 41, 120):
        text = [word() for _ in range(size)]
        for _ in range(9):  # each differs from the last by a word: far ends are linked over others only
            rows.append(" ".join(text))
            text = list(text)
            text[rng.randrange(size)] = word()
    base = [word() for _ in range(60)]
    for _ in range(30):
        t = list(base)
        for _ in range(rng.randrange(3)):
            t[rng.randrange(60)] = word()
        rows.append(" ".join(t))
    passage = [word() for _ in range(45)]
    rows += [" ".join(passage + [word() for _ in range(rng.choice([1, 3, 6, 9]))]) for _ in range(30)]
    rows += [" ".join(word() for _ in range(rng.choice([1, 4, 5, 8, 9, 30]))) for _ in range(30)]
    rows += [rows[0], rows[0].upper(), rows[0].replace(" ", "\t\n"), rows[45] + " \x0b"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("options", [{}, {"limit": 0}, {"limit": 10_000}, {"limit": 38, "crowded": 2, "rounds": 0}, {"limit": 36, "crowded": 3}])
def test_equals_all_pairs(spark, corpus, options):
    assert told(jaccard_join.similar(frame(spark, corpus), **options)) == plain(corpus)


def test_frequent_shingles_only_change_the_order(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 3)
    monkeypatch.setattr(jaccard_join, "MOST_FREQUENT", 40)
    assert told(jaccard_join.similar(frame(spark, corpus))) == plain(corpus)


def test_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    four = "a b c d e f g h"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, four), (8, four + " i"), (9, long), (10, long + " x"), (11, "É é"), (12, "é é")]
    rows += [(7, four), (7, four + " other words at the end"), (None, "one two"), (None, "nobody else"), (None, None), (20, "u v"), (21, "x" * 100_000), (22, "x" * 100_000)]
    assert told(jaccard_join.similar(frame(spark, rows))) == plain(rows)
    assert jaccard_join.op11_jaccard(frame(spark, rows).limit(0)).collect() == []


def test_edge_of_the_threshold(spark):
    """Sets of n and m shingles with just enough in common, and one too few."""
    rows, at = [], 0
    for n, m in ((4, 5), (9, 9), (18, 18), (50, 60), (80, 100), (80, 101)):
        need = -(-80 * (n + m) // 180)
        for k in (need, need - 1):
            shared = [f"s{at}-{i}" for i in range(k + 4)]
            for size, mark in ((n, "p"), (m, "q")):
                rows.append((len(rows), " ".join(shared + [f"{mark}{at}-{i}" for i in range(size - k)])))
            at += 1
    assert told(jaccard_join.similar(frame(spark, rows), limit=55)) == plain(rows)
    assert told(jaccard_join.similar(frame(spark, rows))) == plain(rows)


def test_hashes_follow_the_words():
    texts = [b"a b c d e f", b"A  b\tc D e", None, b"", b"b a c d e", "é x".encode()]
    sets = jaccard_join.shingle_sets(texts)
    assert [len(s) for s in sets] == [2, 1, 0, 0, 1, 1]
    assert sets[1][0] in sets[0] and sets[4][0] not in sets[0]
    assert all((np.diff(s.astype(object)) > 0).all() for s in sets)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not mounted")
def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = jaccard_join.op11_jaccard(docs).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "component_id")
    assert told(got) == plain(rows)
