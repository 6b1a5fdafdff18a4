"""Jaccard join of word n-gram sets by a size-aware heavy-light method, down to connected components.

Sets are read from the texts as sorted 64-bit hashes of shingles; equal sets are one class. Every set is put in one
global order (shingles known to be frequent last), and sets that are similar enough must share some of their first
shingles. Light sets, of at most a boundary size, post every `SUBSET`-element subset of that beginning and meet where
subsets are equal; heavy sets scan the inverted lists of the single shingles of theirs. The boundary is the one of
least estimated cost. Every candidate pair is verified on the whole sets.

Components need no more links than members, so a list with many sets is first linked to hubs, then each set to the
nearest of another component, by a lossless bit test; at last all pairs of components still apart are verified behind
that test. Nothing is capped or left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripspark.llm.common import join_sized
from tripspark.llm.components import connected
from tripspark.session import checkpointed

WIDTH = 5  # words of a shingle
PERCENT = 80  # 100 * intersection >= PERCENT * union is a link
SUBSET = 2  # shingles of a light set's key
CANDIDATE = 4  # cost of a candidate pair, in postings
FREQUENT = 2  # sets of a list from which a shingle may count as frequent
MOST_FREQUENT = 1_000_000  # frequent shingles that the order knows (16 MB)
PARITIES = 1024  # bits in which the parities of a set's shingles are kept
CROWDED = 32  # sets of a list from which it is linked to hubs first
ROUNDS = 1  # rounds in which a set of an open list is verified against its nearest only
PART_BYTES = 1_000_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))  # a random number for each byte
_ODD = _mix(np.arange(300, 300 + WIDTH, dtype=np.uint64)) | _U(1)  # and for each place in a shingle
_STEP = _U(0xD1342543DE82EF95)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, *range(9, 14)]] = True


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every word of lower-cased ``text``: a polynomial over its bytes, mixed with its length."""
    letters = np.frombuffer(text.translate(_LOWER), dtype=np.uint8)
    inside = ~_IS_SPACE[letters]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, sizes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = sizes - starts
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    first = np.cumsum(sizes) - sizes
    powers = np.cumprod(np.full(int(sizes.max()), _STEP, dtype=np.uint64))
    terms = _BYTE[letters[inside]] * powers[np.arange(int(sizes.sum())) - np.repeat(first, sizes)]
    return _mix(np.add.reduceat(terms, first) + sizes.astype(np.uint64) * _U(0xA24BAED4963EE407)), starts


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text; one for a text of fewer words, none without a word."""
    texts = [t or b"" for t in texts]
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    words, starts = word_hashes(b" ".join(texts))
    ends = np.searchsorted(starts, np.cumsum(sizes))  # words up to the end of each text
    n = len(words) - WIDTH + 1
    whole = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(WIDTH if n > 0 else 0):
        whole += words[k : k + n] * _ODD[k]
    whole = _mix(whole)
    out, low = [], 0
    for high in ends.tolist():
        if high - low >= WIDTH:
            out.append(np.unique(whole[low : high - WIDTH + 1]))
        elif high > low:
            short = words[low:high]
            out.append(_mix(np.array([(short * _ODD[: len(short)]).sum(dtype=np.uint64) + _U(len(short))], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        low = high
    return out


def _sets_of(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sets of a column of texts in UTF-8, in parts: place of the first and the sets."""
    texts = column.to_pylist()
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t or b"") > PART_BYTES:
            yield start, shingle_sets(texts[start:i])
            start, held = i, 0
        held += len(t or b"")
    if start < len(texts):
        yield start, shingle_sets(texts[start:])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sig, node, n, bits) of each row: hash of the text, number of the set, its size, and `PARITIES` parities of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in _sets_of(batch.column(2)):
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
                bits = [np.packbits(np.bincount((s % _U(PARITIES)).astype(np.int64), minlength=PARITIES).astype(np.uint8) & 1).tobytes() for s in sets]
                columns = [c[at : at + len(sets)] for c in (batch.column(0), batch.column(1))]
                columns += [pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "sig", "node", "n", "bits"])

    return _narrow(docs, id_col, text_col).mapInArrow(run, "id long, sig long, node long, n long, bits binary")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("sig"), F.col(text_col).cast("binary").alias("body"))


def _bodies(narrow: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, body): the text of one row for each node of ``wanted`` (node, id, sig), rows that repeat it repeated."""
    told = wanted.select("node", F.col("id").alias("__id"), F.col("sig").alias("__sig"))
    return join_sized(narrow, told, F.col("id").eqNullSafe(F.col("__id")) & (F.col("sig") == F.col("__sig")), "inner").select("node", "body")


# What a set of n shingles can be linked with: a larger set, or a smaller one, shares at least so many shingles with it.
def _with_larger(n):
    return -(-2 * PERCENT * n // (100 + PERCENT))


def _with_smaller(n):
    return -(-PERCENT * n // 100)


def beginnings(n, subset: int):
    """Lengths of the beginnings that share ``subset`` shingles with every linked set: larger or equal, smaller or equal."""
    return n - _with_larger(n) + subset, n - _with_smaller(n) + subset


def frequent_shingles(bodies: DataFrame, most: int = MOST_FREQUENT) -> tuple[np.ndarray, np.ndarray, float]:
    """Shingles in the most lists, at most ``most`` of them, with their counts; and the length of the list of a mean posting.

    All sets are counted, each with the shingles that come first by hash. The order changes costs, never results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets_of(batch.column(1)):
                if first := [s[: len(s) // 4 + SUBSET] for s in sets]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64))], names=["h"])

    counts = bodies.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    often = checkpointed(counts.withColumn("h", F.when(F.col("c") >= FREQUENT, F.col("h"))).groupBy("h", "c").agg(F.count(F.lit(1)).alias("k")))
    told = often.groupBy("c").agg(F.sum("k").alias("k")).sort(F.desc("c")).collect()  # lengths of lists: few
    limit, found = FREQUENT, 0
    for r in told:
        found += r.k if r.c >= FREQUENT else 0
        if found > most:
            limit = r.c + 1
            break
    postings = sum(r.c * r.k for r in told if r.c < limit)
    mean = sum(r.c * r.c * r.k for r in told if r.c < limit) / max(postings, 1)
    rows = often.filter((F.col("c") >= limit) & F.col("h").isNotNull()).select("h", "c").toArrow()  # at most ``most``
    h, c = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], c[order], mean


def boundary(sizes: dict[int, int], mean_list: float) -> int:
    """The largest light size, of least cost for so many sets of each size: rows of subsets against postings and candidates."""
    n = np.array(sorted(sizes), dtype=np.int64)
    if not len(n):
        return 0
    sets = np.array([sizes[int(x)] for x in n])
    _, two = beginnings(n, SUBSET)
    short, one = beginnings(n, 1)
    heavy = sets * one * (1 + CANDIDATE * mean_list)
    border = np.array([(sets * short)[(n <= b) & (n >= _with_smaller(b + 1))].sum() for b in n])
    cost = np.cumsum(sets * two * (two - 1) / 2) + heavy.sum() - np.cumsum(heavy) + border
    return int(n[cost.argmin()]) if cost.min() < heavy.sum() else 0


def postings(bodies: DataFrame, order: tuple[np.ndarray, np.ndarray], limit: int) -> DataFrame:
    """(key, node, m): m is four times the size plus 1 if the set may be the smaller of a pair here, plus 2 if the larger."""
    shared = bodies.sparkSession.sparkContext.broadcast(order)  # bounded by MOST_FREQUENT

    def keys_of(s: np.ndarray, among: np.ndarray, triangles: dict) -> list[tuple[np.ndarray, np.ndarray]]:
        n = len(s)
        if among.any():
            rare = s[among == 0]
            s = np.concatenate([rare, s[among > 0][np.argsort(among[among > 0], kind="stable")]])
        out = []
        if n <= limit:
            short, long = (min(x, n) for x in beginnings(n, SUBSET))
            if long not in triangles:
                triangles[long] = np.triu_indices(long, 1)
            i, j = triangles[long]
            out.append((_mix(s[i] * _ODD[0] + s[j] * _ODD[1]), 2 + (j < short)))
        short, long = (min(x, n) for x in beginnings(n, 1))
        if n > limit:
            out.append((s[:long], 2 + (np.arange(long) < short)))
        elif n >= _with_smaller(limit + 1):  # may be the smaller of a pair with a heavy set
            out.append((s[:short], np.ones(short, dtype=np.int64)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        triangles: dict = {}
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for at, sets in _sets_of(batch.column(1)):
                flat = np.concatenate(sets)
                among = np.zeros(len(flat), dtype=np.int64)  # count of a frequent shingle, else 0
                if len(known):
                    where = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                    among = np.where(known[where] == flat, counts[where], 0)
                keys, owners, ms, low = [], [], [], 0
                for k, s in enumerate(sets):
                    for key, role in keys_of(s, among[low : low + len(s)], triangles):
                        keys.append(key)
                        owners.append(np.full(len(key), nodes[at + k]))
                        ms.append(4 * len(s) + role)
                    low += len(s)
                if keys:
                    columns = [np.concatenate(keys).view(np.int64), np.concatenate(owners), np.concatenate(ms)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "m"])

    return bodies.mapInArrow(run, "key long, node long, m long")


def _eligible(m: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether sets of sizes and roles ``m`` and ``others`` can be linked by the list in which they meet."""
    n, o = m >> 2, others >> 2
    as_smaller = (n <= o) & (m & 1 > 0) & (others & 2 > 0)
    as_larger = (n >= o) & (m & 2 > 0) & (others & 1 > 0)
    return (as_smaller | as_larger) & (100 * np.minimum(n, o) >= PERCENT * np.maximum(n, o))


def candidates(posted: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(kind, x, y, z): kind 0 is a candidate pair of nodes x < y; kind 1 is a posting (key, node, m) of a crowded list.

    Lists of up to ``crowded`` sets give all their pairs. Longer ones give a pair of each set with a hub, the smallest
    set that can be linked with it, and their postings; they pass in pieces, so that a list of any length fits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, dtype=np.int64)] * 3
        open_key, hub = None, None

        def out(pairs, rows):
            xs = [np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64), np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)]
            low, high = np.minimum(*xs), np.maximum(*xs)
            distinct = np.unique(np.stack([low, high], axis=1)[low != high], axis=0) if len(low) else np.zeros((0, 2), np.int64)
            ys = [np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64) for i in range(3)]
            kind = np.concatenate([np.zeros(len(distinct), np.int8), np.ones(len(ys[0]), np.int8)])
            columns = [np.concatenate([distinct[:, 0], ys[0]]), np.concatenate([distinct[:, 1], ys[1]]), np.concatenate([np.zeros(len(distinct), np.int64), ys[2]])]
            return pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, columns)], names=["kind", "x", "y", "z"])

        def stars(node, m, hub):
            """Pairs of a piece of a crowded list, ordered by size, with hubs; and the last hub."""
            pairs, at = [], 0
            while at < len(m):
                if hub is None or 100 * (hub[1] >> 2) < PERCENT * (m[at] >> 2):
                    able = np.flatnonzero(m[at:] & 1)
                    if not len(able):
                        return pairs, hub
                    at += int(able[0])
                    hub = node[at], m[at]
                end = int(np.searchsorted(m >> 2, 100 * (hub[1] >> 2) // PERCENT, side="right"))
                good = _eligible(m[at:end], np.full(end - at, hub[1]))
                pairs.append((node[at:end][good], np.full(int(good.sum()), hub[0])))
                at = max(end, at + 1)
            return pairs, hub

        for batch in batches:
            k, node, m = (np.concatenate([r, batch.column(i).to_numpy()]) for i, r in enumerate(rest))
            pairs, rows = [], []
            if open_key is not None and len(k):
                more = int(np.searchsorted(k, open_key, side="right"))
                if more:
                    found, hub = stars(node[:more], m[:more], hub)
                    pairs += found
                    rows.append((k[:more], node[:more], m[:more]))
                    k, node, m = k[more:], node[more:], m[more:]
                if len(k):
                    open_key = None
            if len(k):
                last = int(np.searchsorted(k, k[-1], side="left"))
                starts = np.flatnonzero(np.diff(k[:last], prepend=k[0] - 1 if last else 0)) if last else np.zeros(0, np.int64)
                sizes = np.diff(np.append(starts, last))
                two = starts[sizes == 2]
                good = _eligible(m[two], m[two + 1])
                pairs.append((node[two[good]], node[two[good] + 1]))
                for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                    p, q = node[s : s + n], m[s : s + n]
                    if not (q & 1).any():
                        continue
                    if n <= crowded:
                        i, j = np.nonzero(np.triu(_eligible(q[:, None], q[None, :]), 1))
                        pairs.append((p[i], p[j]))
                    else:
                        pairs += stars(p, q, None)[0]
                        rows.append((k[s : s + n], p, q))
                k, node, m = k[last:], node[last:], m[last:]
                if len(k) > crowded:
                    open_key = k[0]
                    found, hub = stars(node, m, None)
                    pairs += found
                    rows.append((k, node, m))
                    k, node, m = k[:0], node[:0], m[:0]
            rest = [k, node, m]
            yield out(pairs, rows)
        k, node, m = rest
        if len(k) > 1:  # at most ``crowded`` sets of the last list
            i, j = np.nonzero(np.triu(_eligible(m[:, None], m[None, :]), 1))
            yield out([(node[i], node[j])], [])

    dealt = posted.repartition("key").sortWithinPartitions("key", "m", "node")
    return dealt.mapInArrow(run, "kind byte, x long, y long, z long")


def _spare(total: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many parities more two sets of ``total`` shingles together could differ in; negative if they are no link.

    Sets with d shingles not in common differ in at most d parities, so no link is lost.
    """
    apart = np.bitwise_count(one ^ other).sum(axis=-1, dtype=np.int64)
    return total - 2 * (-(-PERCENT * total // (100 + PERCENT))) - apart


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, PARITIES // 64)


def _pairs_left(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pairs (u, v) that their parities do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = _spare(batch.column(2).to_numpy(), _words(batch.column(3)), _words(batch.column(4))) >= 0
            yield batch.select([0, 1]).filter(pa.array(good))

    one, two = (wanted.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}")) for x in "uv")
    told = pairs.join(one, "u").join(two, "v").select("u", "v", (F.col("nu") + F.col("nv")).alias("total"), "bu", "bv")
    return told.mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, narrow: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links (u, v) among candidate pairs (u, v): by their parities, then by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in _sets_of(batch.column(1)):
                ends = np.cumsum([0, *map(len, sets)])
                arrays = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(sets)], arrays], names=["node", "set"])

    pairs = checkpointed(_pairs_left(pairs.distinct(), wanted))
    named = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = checkpointed(_bodies(narrow, wanted.join(named, "node", "left_semi")).mapInArrow(run, "node long, set array<long>").dropDuplicates(["node"]))
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("s")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("t")), "v")
    both = both.select("u", "v", F.size("s").alias("ns"), F.size("t").alias("nt"), F.size(F.array_intersect("s", "t")).alias("k"))
    return checkpointed(both.filter(f"100L * k >= {PERCENT}L * (ns + nt - k)").select("u", "v"))


def _still_apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, m, root) of the lists whose sets are not all in one component."""
    told = rows.join(roots.withColumnRenamed("root", "__root"), "node", "left")
    told = told.select("key", "node", "m", F.coalesce("__root", "node").alias("root"))
    apart = told.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    return checkpointed(told.join(apart, "key", "left_semi"))


def _open_pairs(rows: DataFrame, bits: DataFrame, nearest: bool) -> DataFrame:
    """Pairs (u, v) of different components in the open lists that their parities do not rule out.

    All of them, or with ``nearest`` for each set of a list the one whose parities leave the most room.
    """

    def of(node, m, root, b):
        n = len(node)
        room, other = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for i in range(n - 1):
            end = int(np.searchsorted(m >> 2, 100 * (m[i] >> 2) // PERCENT, side="right"))
            o = slice(i + 1, end)
            at = np.flatnonzero(_eligible(m[o], np.full(max(end - i - 1, 0), m[i])) & (root[o] != root[i])) + i + 1
            if not len(at):
                continue
            spare = _spare((m[at] >> 2) + (m[i] >> 2), b[at], b[i])
            at, spare = at[spare >= 0], spare[spare >= 0]
            if not len(at):
                continue
            if not nearest:
                yield at, np.full(len(at), i)
                continue
            if (best := int(spare.argmax())) >= 0 and spare[best] > room[i]:
                room[i], other[i] = spare[best], at[best]
            more = spare > room[at]
            room[at[more]], other[at[more]] = spare[more], i
        found = np.flatnonzero(room >= 0)
        if len(found):
            yield found, other[found]

    def named(node, m, root, b):
        for i, j in of(node, m, root, b):
            pairs = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else []
            for s, e in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[s] != now and held:
                    yield from named(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                now = keys[s]
                held.append((*(batch.column(i)[s:e].to_numpy() for i in (1, 2, 3)), _words(batch.column(4)[s:e])))
        if held:
            yield from named(*(np.concatenate(x) for x in zip(*held, strict=True)))

    told = rows.join(bits, "node").select("key", "node", "m", "root", "bits")
    return told.repartition("key").sortWithinPartitions("key", "m", "node").mapInArrow(run, "u long, v long").distinct()


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int | None = None, crowded: int = CROWDED, rounds: int = ROUNDS) -> DataFrame:
    """(id, n, component_id) of every row of ``docs``: size of its set and the smallest id reachable over links.

    Null and empty texts have no set and are linked with nothing: their component is their own id. Repeated rows keep
    their rows; a null id is returned as null and names a component only where nothing else is in it; other columns
    are not read. ``limit`` sets the largest light size instead of the cost.
    """
    marked = checkpointed(classes(docs, id_col, text_col))
    whole = marked.filter("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.min(F.struct("id", "sig", "n", "bits")).alias("r"))
    whole = checkpointed(whole.select("node", "least", "r.*"))
    roots = _roots(_narrow(docs, id_col, text_col), whole, limit, crowded, rounds)
    rooted = whole.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    told = rooted.join(named, "root").select(F.col("node").alias("__node"), "component_id")
    found = join_sized(marked.select("id", "node", "n"), told, F.col("node") == F.col("__node"), "left")
    return found.select("id", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _roots(narrow: DataFrame, whole: DataFrame, limit: int | None, crowded: int, rounds: int) -> DataFrame:
    """(node, root) for every set with a link."""
    # the smallest set with a partner of another size: n of n + 1 shingles in common
    least = -(-PERCENT // (100 - PERCENT))
    able = whole.filter(F.col("n") >= least)
    bodies = _bodies(narrow, able)
    known, counts, mean = frequent_shingles(bodies)
    if limit is None:
        sizes = able.filter("n <= 1000").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()  # at most 1,000 rows
        limit = boundary({r.n: r.k for r in sizes}, mean)
    met = checkpointed(candidates(postings(bodies, (known, counts), limit), crowded))
    tried = checkpointed(met.filter("kind = 0").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct())
    links = verified(tried, narrow, able)
    rows = met.filter("kind = 1").select(F.col("x").alias("key"), F.col("y").alias("node"), F.col("z").alias("m"))
    bits = able.select("node", "bits")
    for turn in range(rounds + 1):
        roots = checkpointed(connected(links))
        rows = _still_apart(rows, roots)
        if rows.isEmpty():
            return roots
        # the last round compares whatever is still apart
        pairs = checkpointed(_open_pairs(rows, bits, nearest=turn < rounds).join(tried, ["u", "v"], "left_anti"))
        found = verified(pairs, narrow, able)
        if turn == rounds:
            return roots if found.isEmpty() else connected(links.union(found))
        if found.isEmpty():  # the nearest are no links: look at all that is left
            found = verified(_open_pairs(rows, bits, nearest=False).join(tried, ["u", "v"], "left_anti"), narrow, able)
            return roots if found.isEmpty() else connected(links.union(found))
        links, tried = checkpointed(links.union(found)), checkpointed(tried.union(pairs))


def op11_jaccard(docs: DataFrame) -> DataFrame:
    """Contract columns of the join, one row per document."""
    return similar(docs.select("doc_id", "text")).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets),
met AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS k FROM flat a JOIN flat b USING (h) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM met WHERE 100 * k >= 80 * (nu + nv - k)),
twoway AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(u, v) AS (SELECT u, v FROM twoway UNION SELECT r.u, b.v FROM reach r JOIN twoway b ON r.v = b.u),
least AS (SELECT u, min(v) AS low FROM reach GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM sets LEFT JOIN least ON u = doc_id
"""
