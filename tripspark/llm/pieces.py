"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A text is one leading space and the text itself, cut before every run of spaces; no piece reaches over such a cut.
In each chunk the agenda holds every adjacent pair whose union is a piece; the best pair (score, then leftmost) is
taken; a keyed hash decides whether it is skipped, else it is merged and its new neighbours enter. The hash is keyed
by seed, document, place of the chunk in the document, place in the chunk and piece, so every occurrence of a word is
drawn for by itself, the same way in every run. What follows from a word and the steps at which it was skipped so far
is worked out once for a batch, many at a time; occurrences only draw. Letters without a piece, and the letter that stands for a space in pieces, become
byte pieces, so decoding gives every text back.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 7
DROPOUT = 0.1
SHORT = 24  # letters of a chunk that is worked out in a batch; longer ones use a heap
PART_CHARS = 1_200_000  # letters of a batch at once

_SPACE = "▁"
_CHUNK = re.compile(r" +[^ ]*|[^ ]+")
_NONE = np.iinfo(np.int32).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draw(key: np.ndarray, place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each candidate merge."""
    x = key ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + piece.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return (_mix(x) >> np.uint64(11)).astype(np.float64) * 2.0**-53


_WRAP = (1 << 64) - 1


def _draw_one(key: int, place: int, piece: int) -> float:
    """`_draw` of one candidate."""
    x = key ^ ((place * 0x9E3779B97F4A7C15 + piece * 0xD6E8FEB86659FD93) & _WRAP)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _WRAP
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _WRAP
    return ((x ^ (x >> 31)) >> 11) * 2.0**-53


@dataclass
class Vocabulary:
    """Arrays of a BPE model: letters, merges as sorted pair keys, and the bytes of every piece."""

    letters: np.ndarray  # piece of each code point, 0 if none
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    pair_pieces: np.ndarray
    spelled: list[bytes]
    first_byte: int

    def __post_init__(self):
        # an open hash table of the pair keys, four slots or more to a key
        self._bits = max(4, (4 * len(self.pair_keys)).bit_length())
        self._slots = np.full(1 << self._bits, -1, dtype=np.int32)
        todo, slot = np.arange(len(self.pair_keys), dtype=np.int32), self._slot(self.pair_keys)
        while len(todo):
            free = self._slots[slot] < 0
            self._slots[slot[free]] = todo[free]
            left = self._slots[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & ((1 << self._bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self._bits)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; rank `_NONE` if the union is no piece."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        slot = self._slot(keys)
        at = self._slots[slot]
        hit = (at >= 0) & (self.pair_keys[at] == keys)
        todo = np.flatnonzero((at >= 0) & ~hit)
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self._bits) - 1)
            at[todo] = self._slots[slot[todo]]
            found = self.pair_keys[at[todo]] == keys[todo]
            hit[todo] = (at[todo] >= 0) & found
            todo = todo[(at[todo] >= 0) & ~found]
        ranks, unions = np.where(hit, self.pair_ranks[at], _NONE), np.where(hit, self.pair_pieces[at], 0)
        return ranks.reshape(left.shape), unions.reshape(left.shape)

    def plain(self) -> tuple:
        """The fields, for a broadcast that workers can read without this package."""
        return self.letters, self.pair_keys, self.pair_ranks, self.pair_pieces, self.spelled, self.first_byte


def load(path: str = MODEL) -> Vocabulary:
    """Read a model file on the driver; executors get the arrays."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    size = m.get_piece_size()
    pieces = [m.id_to_piece(i) for i in range(size)]
    bytes_at = [i for i in range(size) if m.is_byte(i)]
    plain = {p: i for i, p in enumerate(pieces) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
    spelled = [b""] * size
    for k, i in enumerate(bytes_at):
        spelled[i] = bytes([k])
    letters = np.zeros(0x110000, dtype=np.int32)
    score_rank = {s: r for r, s in enumerate(sorted({m.get_score(i) for i in plain.values()}, reverse=True))}
    merges = []
    for p, i in plain.items():
        spelled[i] = p.replace(_SPACE, " ").encode()
        if len(p) == 1:
            letters[ord(" " if p == _SPACE else p)] = i
        merges += [(plain[p[:k]] << 32 | plain[p[k:]], score_rank[m.get_score(i)], i) for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
    keys, ranks, ids = (np.array(x) for x in zip(*sorted(merges), strict=True))
    return Vocabulary(letters, keys, ranks.astype(np.int32), ids.astype(np.int32), spelled, bytes_at[0])


def _codes(chunks: list[str]) -> np.ndarray:
    return np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _block(v: Vocabulary, symbols: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Work out chunks of one length, ``skips`` telling the steps at which the candidate is skipped.

    Pieces at the places where they start, whether one starts there; place and piece of the candidate of each step,
    the place -1 after the last. Rows are linked lists, so a merge moves nothing.
    """
    n, width = symbols.shape
    alive = np.ones((n, width), dtype=bool)
    tried_at, tried = np.full(skips.shape, -1, dtype=np.int8), np.zeros(skips.shape, dtype=np.int32)
    if width == 1:
        return symbols, alive, tried_at, tried
    ranks, unions = (np.pad(x, ((0, 0), (0, 1)), constant_values=_NONE) for x in v.pairs(symbols[:, :-1], symbols[:, 1:]))
    after = np.tile(np.arange(1, width + 1), (n, 1)).ravel()
    before = np.tile(np.arange(-1, width - 1), (n, 1)).ravel()
    piece, rank_at, union_at, starts = symbols.ravel(), ranks.ravel(), unions.ravel(), alive.ravel()
    live, step = np.arange(n), -1
    while len(live):
        step += 1
        now = ranks[live]
        best = now.argmin(axis=1)
        go = now[np.arange(len(live)), best] != _NONE
        live, best = live[go], best[go]
        if not len(live):
            break
        base = live * width
        at = base + best
        union = union_at[at]
        tried_at[live, step], tried[live, step] = best, union
        skipped = skips[live, step]
        if skipped.any():
            rank_at[at[skipped]] = _NONE
            base, at, union, best = base[~skipped], at[~skipped], union[~skipped], best[~skipped]
            if not len(at):
                continue
        gone = base + after[at]
        far = after[gone]
        piece[at], starts[gone], rank_at[gone], after[at], rank_at[at] = union, False, _NONE, far, _NONE
        right, left = far < width, best > 0
        before[(base + far)[right]] = best[right]
        nearer = (base + before[at])[left]
        where = np.concatenate([at[right], nearer])
        one, two = np.concatenate([union[right], piece[nearer]]), np.concatenate([piece[(base + far)[right]], union[left]])
        rank_at[where], union_at[where] = v.pairs(one, two)
    return symbols, alive, tried_at, tried


def _ways(v: Vocabulary, words: np.ndarray, word_of: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment occurrences of words of one length: the ways that occur, as in `_block`, and the way of each occurrence.

    A way is a word with the steps skipped in it. Occurrences start with the undropped way of their word; those that
    draw a skip go on to the way with that step skipped as well, until the rest of a way is drawn without one.
    """
    width = words.shape[1]
    steps = 3 * width  # each merge offers two candidates at most, and each candidate is merged or skipped
    rows, skips = np.arange(len(words)), np.zeros((len(words), steps), dtype=bool)
    way_of, at, since = np.zeros(len(word_of), dtype=np.int64), np.arange(len(word_of)), np.zeros(len(word_of), dtype=np.int64)
    way = word_of  # of the occurrences ``at``, counted in this round
    found, before = [], 0
    while len(at):
        symbols, alive, tried_at, tried = _block(v, words[rows], skips)
        found.append((symbols, alive))
        way_of[at] = before + way
        before += len(rows)
        if dropout <= 0 or width == 1:
            break
        # every candidate of every occurrence after its last skip, one after the other
        counts = np.maximum((tried_at >= 0).sum(axis=1)[way] - since, 0)
        owner = np.repeat(np.arange(len(at)), counts)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts - since, counts)
        w = way[owner]
        drawn = np.flatnonzero(_draw(keys[at[owner]], tried_at[w, step], tried[w, step]) < dropout)
        more = owner[drawn]
        first = np.diff(more, prepend=-1) > 0
        more, step = more[first], step[drawn[first]]
        at, since = at[more], step + 1
        after, way = np.unique(way[more] * steps + step, return_inverse=True)
        parents = after // steps
        rows, skips = rows[parents], skips[parents]
        skips[np.arange(len(after)), after % steps] = True
    symbols, alive = (np.concatenate(x) for x in zip(*found, strict=True))
    return symbols, alive, way_of


def _heap(v: Vocabulary, symbols: np.ndarray, key: np.uint64, dropout: float) -> tuple[list[int], list[int]]:
    """The same agenda for one long chunk: pieces and the places where they start."""
    n = len(symbols)
    piece, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    stamp = [0] * n  # changes with the piece at a place, so that stale entries can be told
    agenda: list[tuple[int, int, int, int, int, int]] = []
    if n > 1:
        ranks, unions = v.pairs(symbols[:-1], symbols[1:])
        agenda = [(r, i, u, 0, i + 1, 0) for i, (r, u) in enumerate(zip(ranks.tolist(), unions.tolist(), strict=True)) if r != _NONE]
        heapq.heapify(agenda)
    one = int(key)
    keys_of = {}

    def offer(i):
        j = after[i]
        if i >= 0 and j < n:
            pair = piece[i], piece[j]
            if pair not in keys_of:
                r, u = v.pairs(np.array([pair[0]]), np.array([pair[1]]))
                keys_of[pair] = int(r[0]), int(u[0])
            r, u = keys_of[pair]
            if r != _NONE:
                heapq.heappush(agenda, (r, i, u, stamp[i], j, stamp[j]))

    while agenda:
        _, i, union, si, j, sj = heapq.heappop(agenda)
        if stamp[i] != si or stamp[j] != sj:
            continue
        if dropout > 0 and _draw_one(one, i, union) < dropout:
            continue
        piece[i] = union
        stamp[i] += 1
        stamp[j] = -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(i)
        i = after[i]
    return [piece[i] for i in out], out


def _segment(v: Vocabulary, chunks: list[str], keys: np.ndarray, dropout: float, chunk_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all occurrences, one after the other, and where each starts (one more at the end).

    ``keys`` has one key for each occurrence; ``chunk_of`` tells its chunk, each chunk occurring once if not given.
    """
    chunk_of = np.arange(len(chunks)) if chunk_of is None else chunk_of
    lengths = np.array([len(c) for c in chunks], dtype=np.int64)
    letters = _codes(chunks)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    symbols = v.letters[letters]
    sizes_of = lengths[chunk_of]
    offsets = np.concatenate([[0], np.cumsum(sizes_of)])  # places of the occurrences, one after the other
    parts_of, owner_of, place_of = [], [], []
    rank = np.zeros(len(chunks), dtype=np.int64)  # of a chunk among those of its length
    for width in np.unique(lengths[lengths <= SHORT]):
        rows, found = np.flatnonzero(lengths == width), np.flatnonzero(sizes_of == width)
        rank[rows] = np.arange(len(rows))
        s, alive, way = _ways(v, symbols[starts[rows][:, None] + np.arange(width)], rank[chunk_of[found]], keys[found], dropout)
        at, place = np.nonzero(alive[way])
        parts_of.append(s[way[at], place])
        owner_of.append(found[at])
        place_of.append(place + offsets[found[at]])
    for row in np.flatnonzero(sizes_of > SHORT):
        c = chunk_of[row]
        got, at = _heap(v, symbols[starts[c] : starts[c + 1]], keys[row], dropout)
        parts_of.append(np.array(got, dtype=np.int32))
        owner_of.append(np.full(len(got), row))
        place_of.append(np.array(at) + offsets[row])
    pieces, owners, places = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parts_of, owner_of, place_of))
    order = np.argsort(places, kind="stable")  # places rise with the owner and inside it
    pieces, owners, places = pieces[order], owners[order], places[order]
    bare = np.flatnonzero(pieces == 0)
    if len(bare):  # letters without a piece: one piece for each byte
        codes = letters[starts[chunk_of[owners[bare]]] + places[bare] - offsets[owners[bare]]]
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in codes.tolist()]
        width = np.ones(len(pieces), dtype=np.int64)
        width[bare] = [len(b) for b in spelled]
        into = np.repeat(pieces, width)
        first = np.cumsum(width) - width
        for k, b in zip(first[bare].tolist(), spelled, strict=True):
            into[k : k + len(b)] = [v.first_byte + x for x in b]
        pieces, owners = into, np.repeat(owners, width)
    counts = np.bincount(owners, minlength=len(chunk_of)) if len(owners) else np.zeros(len(chunk_of), np.int64)
    return pieces.astype(np.int32), np.concatenate([[0], np.cumsum(counts)])


def encode(v: Vocabulary, texts: list[str | None], names: list[int], dropout: float = DROPOUT, seed: int = SEED) -> list[np.ndarray]:
    """Piece numbers of each text; ``names`` key the draws of a text, e.g. document numbers. None is empty."""
    distinct: dict[str, int] = {}
    found_in, keys = [], []
    for text, name in zip(texts, names, strict=True):
        found = _CHUNK.findall(" " + text) if text else []
        base = np.uint64(xxhash.xxh64_intdigest(str(name).encode(), seed))
        keys.append(_mix(np.arange(len(found), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + base))
        found_in.append(np.array([distinct.setdefault(c, len(distinct)) for c in found], dtype=np.int64))
    if not found_in:
        return []
    pieces, starts = _segment(v, list(distinct), np.concatenate(keys), dropout, np.concatenate(found_in))
    ends = starts[np.concatenate([[0], np.cumsum([len(x) for x in found_in])])]
    return [pieces[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def decode(v: Vocabulary, pieces: np.ndarray) -> str:
    """The text of piece numbers made by `encode`."""
    joined = b"".join(map(v.spelled.__getitem__, pieces.tolist()))
    return joined.decode("utf-8", "surrogatepass")[1:]


def _parts(texts: list[str | None]) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > PART_CHARS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encoded(docs: DataFrame, path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with __pieces: token_ids, n_pieces, ids_sha256 (of little-endian 32-bit numbers) and lossless.

    ``lossless`` tells whether decoding gave back the whole text. A null text is encoded as an empty one, which has
    no pieces; rows with equal id and text get equal pieces; a null id is an id. Other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path).plain())  # the arrays of one vocabulary
    kind = "struct<token_ids: array<int>, n_pieces: bigint, ids_sha256: string, lossless: boolean>"

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        v = Vocabulary(*shared.value)
        for names, body in batches:
            texts, ids = body.to_pylist(), names.to_pylist()
            lists, digests, whole = [], [], []
            for part in _parts(texts):
                got = encode(v, texts[part], ids[part], dropout, seed)
                digests += [hashlib.sha256(g.astype("<i4").tobytes()).hexdigest() for g in got]
                whole += [decode(v, g) == (t or "") for g, t in zip(got, texts[part], strict=True)]
                lists += got
            sizes = np.array([len(g) for g in lists], dtype=np.int64)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            token_ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            yield pa.StructArray.from_arrays(
                [token_ids, pa.array(sizes), pa.array(digests, pa.string()), pa.array(whole, pa.bool_())],
                names=["token_ids", "n_pieces", "ids_sha256", "lossless"],
            )

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return docs.withColumn("__pieces", F.arrow_udf(run, kind)(F.col(id_col).cast("long"), F.col(text)))


def decoded(tokens: DataFrame, path: str = MODEL, column: str = "token_ids", out: str = "text") -> DataFrame:
    """``tokens`` with the texts of a column of piece numbers; a null array gives an empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(load(path).plain())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = Vocabulary(*shared.value)
        for ids in batches:
            yield pd.Series([decode(v, np.asarray(x if x is not None else [], dtype=np.int32)) for x in ids], dtype=object)

    return tokens.withColumn(out, run(F.col(column)))


def op5_pieces(docs: DataFrame) -> DataFrame:
    """Segmentation of every document: numbers of pieces, their digest and the result of the round trip."""
    got = encoded(docs.select("doc_id", "text"))
    return got.select("doc_id", "__pieces.n_pieces", "__pieces.ids_sha256", "__pieces.lossless")
