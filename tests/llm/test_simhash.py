"""SimHash near-duplicates against all pairs, and the awkward rows."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tripspark.llm import simhash
from tripspark.llm.components import connected


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    f = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    label = np.array(ids)
    while True:
        low = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (low == label).all():
            return label
        label = low


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "A b c d e f g", "é É ß x\x0by z", "w " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint_of(None if text is None else text.encode()) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    got = spark.range(1).select(F.hex(F.xxhash64(F.lit("a b é")))).first()[0]
    assert int(got, 16) == xxhash.xxh64_intdigest("a b é".encode(), 42)


def random_fingerprints(rng, n, centres):
    centre = rng.integers(0, 1 << 63, centres, dtype=np.uint64)
    out = centre[rng.integers(0, centres, n)]
    for _ in range(4):
        out = out ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) * (rng.random(n) < 0.5).astype(np.uint64)
    return out


@pytest.mark.parametrize("bound", [2048, 3])
def test_links_give_the_components_of_all_pairs(spark, bound):
    fps = np.unique(random_fingerprints(np.random.default_rng(3), 400, 6))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = simhash.links(frame, bound)
    roots = {r.node: r.root for r in connected(edges).collect()}
    own = fps.view(np.int64).tolist()
    got = [roots.get(x, x) for x in own]
    assert got == plain_components(own, fps).tolist()


def test_awkward_rows(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (3, "A b C d e"), (9, None), (8, ""), (None, "q r s t u"), (7, "z " * 20_000)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fingerprint string, component_id string")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.id or -1, r.component_id or -1) for r in got) == [(-1, -1), (3, 3), (5, 3), (5, 3), (7, 7), (8, 8), (9, 8)]
    assert {r.fingerprint for r in got if r.id in (8, 9)} == {"0" * 16}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 50), (70, 70)], "u long, v long")
    got = {r.node: r.root for r in connected(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50}
