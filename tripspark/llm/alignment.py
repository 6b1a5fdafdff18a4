"""Alignment of two tokenizers by lockstep merging.

Both tokenizers cut the same bytes, a space and the text. Token ends are places in those bytes, so the tokens of a
batch of documents are two rising lists. One state vector holds an A and a B pointer for every open lane; a step links
the tokens under each pair of pointers, cuts where both end, moves whichever ends first and drops finished lanes. A
document is one lane, or several that start where both tokenizers end a token, so that a long document does not keep
the vector short for many steps.

A pair's count is a sum over the whole corpus. Tokens are stored once; counts come from them by a shuffle of sums that
each task has formed. For the documents' sums the counts are read in parts of bounded size, one broadcast at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripspark.session import checkpointed, scratch_path

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
PART_BYTES = 1_500_000  # of text at once
LANE = 384  # A tokens after which a long document starts another lane
WINDOW = 48  # A tokens in which a lane may start
HELD = 3_000_000  # pairs that a counting task holds before it passes them on
PAIR_ROWS = 2_000_000  # pairs of a broadcast part (16 bytes each)
#: How byte-level vocabularies cut a text before merging.
PATTERN_A = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _letter_bytes() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, others from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(a_path: str = TOKENIZER_A, b_path: str = TOKENIZER_B) -> dict:
    """Plain values of both vocabularies: bytes of every token, and the file of B.

    The merges of A must follow the order of their ids, as they do in byte-level vocabularies, for then ranks say all.
    """
    import sentencepiece

    with open(a_path, encoding="utf-8") as f:
        told = json.load(f)
    special = {t["id"] for t in told.get("added_tokens", [])}
    letters = _letter_bytes()
    a = {i: bytes(letters[c] for c in t) for t, i in told["model"]["vocab"].items() if i not in special}
    merged = [m if isinstance(m, str) else " ".join(m) for m in told["model"]["merges"]]
    ids = [told["model"]["vocab"][m.replace(" ", "")] for m in merged]
    if ids != sorted(ids):
        raise ValueError(f"{a_path}: merges do not follow the order of ids")
    with open(b_path, "rb") as f:
        model = f.read()
    m = sentencepiece.SentencePieceProcessor(model_proto=model)
    spelled = [m.id_to_piece(i) for i in range(m.get_piece_size())]
    b = [bytes([int(p[3:-1], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(spelled)]
    return {"a": [a.get(i, b"") for i in range(max(a) + 1)], "b": b, "model": model}


def encoders(vocabulary: dict):
    """Two functions from a text to an array of ids; A's takes the text with its space."""
    import sentencepiece
    import tiktoken

    ranks = {t: i for i, t in enumerate(vocabulary["a"]) if t}
    a = tiktoken.Encoding("a", pat_str=PATTERN_A, mergeable_ranks=ranks, special_tokens={})
    b = sentencepiece.SentencePieceProcessor(model_proto=vocabulary["model"])
    return (
        lambda text: a.encode_to_numpy(text, disallowed_special=()).astype(np.int32),
        lambda text: np.asarray(b.encode(text), dtype=np.int32),
    )


class Bytes:
    """Token bytes as one buffer with places."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.buffer = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens, one after the other."""
        sizes = self.size[ids]
        shift = self.start[ids] - (np.cumsum(sizes) - sizes)
        return self.buffer[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First A token, first B token and A token after the last of each lane.

    Long documents are cut near every `LANE`-th A token, at the first end within `WINDOW` tokens that is an end of B
    too; where there is none, the lane goes on.
    """
    last_a = np.cumsum(sizes_a)
    first_a, first_b = last_a - sizes_a, np.cumsum(sizes_b) - sizes_b
    extra = np.maximum(sizes_a - WINDOW - 1, 0) // LANE  # grid places of each document
    owner = np.repeat(np.arange(len(sizes_a)), extra)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    grid = first_a[owner] + number * LANE
    if len(grid):
        seen = grid[:, None] + np.arange(min(WINDOW, LANE))[None, :]
        inside = seen < last_a[owner][:, None] - 1
        ends = ends_a[np.minimum(seen, len(ends_a) - 1)]
        at = np.minimum(np.searchsorted(ends_b, ends), len(ends_b) - 1)
        shared = inside & (ends_b[at] == ends)
        found = shared.any(axis=1)
        pick = shared.argmax(axis=1)
        rows = np.arange(len(grid))
        new_a, new_b = seen[rows, pick][found] + 1, at[rows, pick][found] + 1
    else:
        new_a = new_b = np.zeros(0, dtype=np.int64)
    filled = sizes_a > 0
    start_a = np.concatenate([first_a[filled], new_a])
    order = np.argsort(start_a, kind="stable")
    start_a = start_a[order]
    start_b = np.concatenate([first_b[filled], new_b])[order]
    # a lane ends where the next one starts; documents stand one after the other
    return start_a, start_b, np.append(start_a[1:], last_a[-1] if len(last_a) else 0)[: len(start_a)]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray, stop_a: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links (A place, B place) and cuts (A place, B place) of all lanes, which move on together, a step at a time."""
    state = np.stack([start_a, start_b, stop_a])
    links, cuts = [], []
    while state.shape[1]:
        end_a, end_b = ends_a[state[0]], ends_b[state[1]]
        links.append(state[:2].copy())
        both = end_a == end_b
        if both.any():
            cuts.append(state[:2, both])
        state[0] += end_a <= end_b
        state[1] += end_b <= end_a
        live = state[0] < state[2]
        if not live.all():
            state = state[:, live]
    empty = np.zeros((2, 0), dtype=np.int64)
    joined = [np.concatenate(x, axis=1) if x else empty for x in (links, cuts)]
    return joined[0][0], joined[0][1], joined[1][0], joined[1][1]


def align(bytes_a: Bytes, bytes_b: Bytes, a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links and cuts of documents whose tokens stand one after the other in ``a`` and ``b`` and spell the same bytes."""
    ends_a, ends_b = np.cumsum(bytes_a.size[a]), np.cumsum(bytes_b.size[b])
    return lockstep(ends_a, ends_b, *lanes(ends_a, ends_b, sizes_a, sizes_b))


def _decimals(size: int) -> np.ndarray:
    """Row i: the digits of i and room for one separator, zero where nothing stands."""
    width = len(str(max(size - 1, 0)))
    text = np.char.ljust(np.arange(size).astype(f"S{width}"), width + 1, b" ").astype(f"S{width + 1}")
    table = text.view(np.uint8).reshape(size, width + 1).copy()
    table[table == 32] = 0
    return table


def digests(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, digits: np.ndarray) -> list[str]:
    """SHA-256 of `a1,a2|b1;a3|b2,b3` of each document: its groups, ids in order; '' without tokens."""
    n_a, n_b = len(a), len(b)
    last_a, last_b = np.zeros(n_a, dtype=bool), np.zeros(n_b, dtype=bool)
    last_a[cut_a], last_b[cut_b] = True, True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")  # a group's A tokens, then its B tokens
    separators = np.concatenate([np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))]).astype(np.uint8)
    rows = digits[np.concatenate([a, b])]
    rows[np.arange(n_a + n_b), (rows != 0).sum(axis=1)] = separators
    rows = rows[order]
    flat = rows.ravel()
    text = flat[flat != 0].tobytes()
    ends = np.cumsum((rows != 0).sum(axis=1))
    out, token, at = [], 0, 0
    for n in (sizes_a + sizes_b).tolist():
        token += n
        end = int(ends[token - 1]) if n else at
        out.append(hashlib.sha256(text[at : end - 1]).hexdigest() if n else "")
        at = end
    return out


def _parts(sizes: list[int], most: int) -> Iterator[slice]:
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def _per(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n).astype(np.int64)


_TOKENS = "rid long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary"


def aligned(docs: DataFrame, vocabulary: dict, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, id, n_a, n_b, n_groups, n_links, groups_sha256, a, b) of every row of ``docs``, stored in the shared folder.

    ``a`` and ``b`` hold the ids as 32-bit little-endian numbers. Null and empty texts, and texts that the two do not
    spell alike (such as those with the letter U+2581), have no tokens. Repeated rows and null ids stay rows of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # two vocabularies, some MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        bytes_a, bytes_b = Bytes(v["a"]), Bytes(v["b"])
        encode_a, encode_b = encoders(v)
        digits = _decimals(max(len(v["a"]), len(v["b"])))
        none = np.zeros(0, dtype=np.int32)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for part in _parts([len(t or "") for t in texts], PART_BYTES):
                found_a, found_b = [], []
                for t in texts[part]:
                    a = b = none
                    if t:
                        whole = np.frombuffer(f" {t}".encode(), dtype=np.uint8)
                        a, b = encode_a(f" {t}"), encode_b(t)
                        if not (np.array_equal(bytes_a.joined(a), whole) and np.array_equal(bytes_b.joined(b), whole)):
                            a = b = none
                    found_a.append(a)
                    found_b.append(b)
                n = len(found_a)
                sizes_a, sizes_b = (np.array([len(x) for x in f], dtype=np.int64) for f in (found_a, found_b))
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                link_a, _, cut_a, cut_b = align(bytes_a, bytes_b, a, b, sizes_a, sizes_b)
                owner = np.repeat(np.arange(n), sizes_a)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part.start : part.stop],
                        batch.column(1)[part.start : part.stop],
                        pa.array(sizes_a),
                        pa.array(sizes_b),
                        pa.array(_per(owner[cut_a], n)),
                        pa.array(_per(owner[link_a], n)),
                        pa.array(digests(a, b, sizes_a, sizes_b, cut_a, cut_b, digits)),
                        pa.array([x.astype("<i4").tobytes() for x in found_a], pa.binary()),
                        pa.array([x.astype("<i4").tobytes() for x in found_b], pa.binary()),
                    ],
                    names=["rid", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b"],
                )

    narrow = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    path = scratch_path(docs.sparkSession, "alignment")
    narrow.mapInArrow(run, _TOKENS).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _links_of(batch: pa.RecordBatch, bytes_a: Bytes, bytes_b: Bytes) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For parts of stored rows (rid, a, b): each link's row in the part and its pair of ids as one number."""
    col_a, col_b = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    for part in _parts([len(x) for x in col_a], 4 * PART_BYTES // 3):
        a, b = (np.frombuffer(b"".join(c[part]), dtype="<i4") for c in (col_a, col_b))
        sizes_a, sizes_b = (np.array([len(x) // 4 for x in c[part]], dtype=np.int64) for c in (col_a, col_b))
        link_a, link_b, _, _ = align(bytes_a, bytes_b, a, b, sizes_a, sizes_b)
        owner = np.repeat(np.arange(len(sizes_a)), sizes_a)
        yield part, owner[link_a], b[link_b].astype(np.int64) << 32 | a[link_a].astype(np.int64)


def pair_counts(stored: DataFrame, vocabulary: dict) -> DataFrame:
    """(pair, c, best): links of each id pair over all rows; ``best`` if no pair of its B id has more."""
    shared = stored.sparkSession.sparkContext.broadcast({"a": vocabulary["a"], "b": vocabulary["b"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_a, bytes_b = Bytes(shared.value["a"]), Bytes(shared.value["b"])
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "c"])
        for batch in batches:
            for _, _, codes in _links_of(batch, bytes_a, bytes_b):
                new, c = np.unique(codes, return_counts=True)
                both, place = np.unique(np.concatenate([pairs, new]), return_inverse=True)
                sums = np.zeros(len(both), dtype=np.int64)
                np.add.at(sums, place, np.concatenate([counts, c]))
                pairs, counts = both, sums
                if len(pairs) > HELD:
                    yield out()
                    pairs, counts = pairs[:0], counts[:0]
        yield out()

    sums = stored.select("rid", "a", "b").mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))
    sums = checkpointed(sums)
    most = sums.groupBy(F.shiftright("pair", 32).alias("b_id")).agg(F.max("c").alias("most"))
    joined = sums.join(F.broadcast(most), F.shiftright(sums.pair, 32) == F.col("b_id"))  # one row per id of B
    return checkpointed(joined.select("pair", "c", (F.col("c") == F.col("most")).alias("best")))


def pair_sums(stored: DataFrame, counts: DataFrame, vocabulary: dict, part_rows: int = PAIR_ROWS) -> DataFrame:
    """(rid, n_best, count_sum) of every row: links whose pair is the best of its B id, and the sum of their counts.

    Counts are broadcast in parts by hash, at most about ``part_rows`` at once; sums over the parts are added.
    """
    context = stored.sparkSession.sparkContext
    parts = max(1, -(-counts.count() // part_rows))
    tokens = {"a": vocabulary["a"], "b": vocabulary["b"]}

    def one(k: int) -> DataFrame:
        held = counts.filter(F.pmod(F.xxhash64("pair"), F.lit(parts)) == k).sort("pair").toArrow()
        columns = {c: held.column(c).to_numpy() for c in ("pair", "c", "best")}
        shared = context.broadcast(tokens | columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = shared.value
            bytes_a, bytes_b = Bytes(v["a"]), Bytes(v["b"])
            pairs, c, best = v["pair"], v["c"], v["best"]
            for batch in batches:
                for part, row, codes in _links_of(batch, bytes_a, bytes_b):
                    n = part.stop - part.start
                    if len(pairs):
                        distinct, back = np.unique(codes, return_inverse=True)
                        at = np.minimum(np.searchsorted(pairs, distinct), len(pairs) - 1)
                        hit = pairs[at] == distinct
                        value, top = np.where(hit, c[at], 0)[back], (hit & best[at])[back]
                        # sums of halves stay exact in floating point
                        low, high = (np.bincount(row, weights=x, minlength=n) for x in (value & 0xFFFFFFFF, value >> 32))
                        sums = low.astype(np.int64) + (high.astype(np.int64) << 32)
                        tops = _per(row[top], n)
                    else:
                        sums = tops = np.zeros(n, dtype=np.int64)
                    columns = [batch.column(0)[part.start : part.stop], pa.array(tops), pa.array(sums)]
                    yield pa.RecordBatch.from_arrays(columns, names=["rid", "n_best", "count_sum"])

        return stored.select("rid", "a", "b").mapInArrow(run, "rid long, n_best long, count_sum long")

    if parts == 1:
        return one(0)
    whole = checkpointed(one(0))
    for k in range(1, parts):
        whole = whole.unionByName(checkpointed(one(k)))
    return whole.groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def op12_alignment(docs: DataFrame, a_path: str = TOKENIZER_A, b_path: str = TOKENIZER_B, part_rows: int = PAIR_ROWS) -> DataFrame:
    """Contract columns of the alignment, one row per row of ``docs``; an empty table gives none."""
    vocabulary = load(a_path, b_path)
    stored = aligned(docs.select("doc_id", "text"), vocabulary)
    sums = pair_sums(stored, pair_counts(stored, vocabulary), vocabulary, part_rows)
    told = stored.select("rid", F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return told.join(sums, "rid").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
