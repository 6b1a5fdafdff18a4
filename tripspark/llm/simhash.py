"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Of two fingerprints that differ in at most three bits
one segment differs in at most one bit, so the two share a key "segment with one bit deleted". Each distinct
fingerprint posts its 64 keys; equal keys meet in one sort; every meeting pair is verified on all 64 bits.
Copies share a fingerprint and are folded before, so a group of copies costs one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripspark.llm.components import connected
from tripspark.session import checkpointed

WIDTH = 3  # words of a shingle
SEED = 42  # of XXH64
DISTANCE = 3  # differing bits of a link
#: Keys shared by more distinct fingerprints than this are not compared pair by pair but by `dense_links`.
RUN_BOUND = 2048

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint_of(text: bytes | None) -> int:
    """Unsigned fingerprint of one UTF-8 text; zero without a word."""
    found = (text or b"").translate(_LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - WIDTH + 1)
    pairs = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), dtype=np.uint64, count=n)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):  # bounded memory for very long texts
        part = hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, sig) for each row; ``fp`` holds the 64 bits as a signed long, ``sig`` is a hash of the text as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint_of(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64)), batch.column(2)], names=["id", "fp", "sig"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"), F.xxhash64(text_col).alias("sig"))
    return narrow.mapInArrow(run, "id long, fp long, sig long")


def keys(distinct: DataFrame) -> DataFrame:
    """(key, fp): the 64 one-wildcard segment variants of each fingerprint."""
    posted = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j"))
    segment = "CASE WHEN j < 32 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END"
    return posted.select(F.expr(f"shiftleft(CAST(j AS BIGINT), 32) | (({segment}) & ~shiftleft(1L, j % 32))").alias("key"), "fp")


def _run_links(keys_: np.ndarray, fps: np.ndarray, bound: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links inside runs of equal keys; a fingerprint of a run over ``bound`` is linked to itself, as a mark."""
    starts = np.flatnonzero(np.concatenate([[True], keys_[1:] != keys_[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(keys_)]]))
    two = starts[sizes == 2]
    near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= DISTANCE
    us, vs = [fps[two][near]], [fps[two + 1][near]]
    for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        run = fps[s : s + n]
        if n > bound:
            us.append(run)
            vs.append(run)
            continue
        linked = np.bitwise_count(run[:, None] ^ run[None, :]) <= DISTANCE
        label = np.arange(n)
        while True:  # smallest reachable member, so that a run gives fewer links than members
            low = np.where(linked, label[None, :], n).min(axis=1)
            if (low == label).all():
                break
            label = low
        moved = label != np.arange(n)
        us.append(run[moved])
        vs.append(run[label[moved]])
    return us, vs


def links(distinct: DataFrame, bound: int = RUN_BOUND) -> DataFrame:
    """(u, v) links that give the same components as all pairs of fingerprints within `DISTANCE` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        dense_key = None  # a run that has outgrown the bound is passed on piece by piece

        def out(us, vs):
            u, v = np.concatenate(us), np.concatenate(vs)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            k = np.concatenate([rest_k, batch.column(0).to_numpy()])
            f = np.concatenate([rest_f, batch.column(1).to_numpy().view(np.uint64)])
            if dense_key is not None:
                more = int(np.searchsorted(k, dense_key, side="right"))
                if more:
                    yield out([f[:more]], [f[:more]])
                    k, f = k[more:], f[more:]
                if len(k):
                    dense_key = None
            if not len(k):
                rest_k, rest_f = k, f
                continue
            last = int(np.searchsorted(k, k[-1], side="left"))
            if last:
                yield out(*_run_links(k[:last], f[:last], bound))
            rest_k, rest_f = k[last:], f[last:]
            if len(rest_k) > bound:
                dense_key = rest_k[0]
                yield out([rest_f], [rest_f])
                rest_k, rest_f = rest_k[:0], rest_f[:0]
        if len(rest_k):
            yield out(*_run_links(rest_k, rest_f, bound))

    met = keys(distinct).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "u long, v long")
    found = checkpointed(met.distinct())
    dense = found.filter("u = v").select(F.col("u").alias("fp"))
    proper = found.filter("u <> v")
    return proper if dense.isEmpty() else proper.union(dense_links(dense))


def dense_links(dense: DataFrame) -> DataFrame:
    """Links among fingerprints of crowded keys, in rows that grow with their number, not with its square.

    Two fingerprints are at most three bits apart exactly if some value is at most one bit from the one and at
    most two from the other. Each posts the values within two bits; those within one bit name a hub for a value,
    and all that posted the value link to its hub.
    """
    ones = [1 << i for i in range(64)]
    twos = [a | b for i, a in enumerate(ones) for b in ones[:i]]
    signed = [m - (1 << 64) if m >> 63 else m for m in [0, *ones, *twos]]
    masks = F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("at", "mask")
    posted = dense.distinct().select("fp", masks).select("fp", F.expr("fp ^ mask").alias("x"), F.expr("at <= 64").alias("near"))
    hubs = posted.filter("near").groupBy("x").agg(F.min("fp").alias("hub"))
    return posted.join(hubs, "x").filter("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = RUN_BOUND) -> DataFrame:
    """(id, fingerprint, component_id, sig) for each row of ``docs``; ``sig`` is a hash of the text.

    component_id is the smallest id reachable over links of at most three differing bits. Null and empty texts
    have fingerprint zero and link like any other; repeated rows keep their rows; a null id is returned as null
    and names a component only where nothing else is in it; other columns of ``docs`` are not read.
    """
    marked = checkpointed(fingerprints(docs, id_col, text_col))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected(links(distinct, bound)).withColumnsRenamed({"node": "fp"})
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return marked.join(classes, "fp").select("id", digits.alias("fingerprint"), "component_id", "sig")


def op7_simhash(docs: DataFrame) -> DataFrame:
    """Contract columns of the near-duplicates, one row per document."""
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "fingerprint", "component_id")
