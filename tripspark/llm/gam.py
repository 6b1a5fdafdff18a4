"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one feature (later one pair) at a time; each tree adds its leaf values to
the lookup table of its feature or pair. A score is the intercept plus one table entry per feature and pair,
through the logistic function. Features come from the text alone. The fit reads at most `SAMPLE` labelled rows,
taken in hash order; scoring reads every row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripspark.llm.common import fold, hash_order

SAMPLE = 20_000  # labelled rows of a fit at most
BINS = 32  # of a feature
PAIR_BINS = 8  # of each side of a pair
PAIRS = 6  # interactions kept
RATE = 0.1
ROUNDS = 60  # sweeps over the features, and then over the pairs, at most
LEAF_ROWS = 10
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "punctuation_share", "letter_share",
    "marked_words", "exclaimed_words", "cell_words", "repeated_words", "repeated_windows", "distinct_share",
    "repeated_lines", "line_words", "sentence_words", "long_words", "space_share",
)

_SYMBOL = re.compile(r"[#*$%&|<>{}\[\]\\^~=_@]")
_PUNCT = re.compile(r"[.,;:!?'\"()\-]")


def measure(text: str | None) -> list[float]:
    """The features of one whole text; an empty or null text has none of anything."""
    text = text or ""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    low = text.lower()
    upper = sum(map(str.isupper, text)) if low != text else 0
    symbols, points = len(_SYMBOL.findall(text)), len(_PUNCT.findall(text))
    spaces = size - sum(map(len, words)) if words else 0
    digits = sum(map(text.count, "0123456789"))
    counts = Counter(words)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    again = sum(c for c in windows.values() if c > 1)
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    m = max(1, len(lines))
    letters = max(1, size - spaces - symbols - points - digits)
    return [
        np.log1p(len(words)), sum(map(len, words)) / n, upper / letters, digits / size, symbols / size, points / size, letters / size,
        sum(w[-1] in "#*$%&" for w in words) / n, text.count("!") / n, text.count("|") / n,
        1 - len(counts) / n, again / max(1, len(words) - 2), counts.most_common(1)[0][1] / n if words else 0.0,
        1 - len(set(lines)) / m, len(words) / m, len(words) / (1 + text.count(".") + text.count("!") + text.count("?")),
        sum(len(w) > 12 for w in words) / n, spaces / size,
    ]


def features(texts) -> np.ndarray:
    return np.array([measure(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass
class Model:
    edges: list[np.ndarray]  # cut points of each feature
    intercept: float
    tables: list[np.ndarray]  # a value for each bin of each feature
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # cut points for pairs
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.arange(1, bins) / bins, method="higher"))


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = np.where((nl >= LEAF_ROWS) & (nr >= LEAF_ROWS), gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1), 0.0)
    at = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf value of every bin under a tree of at most ``depth`` levels."""
    gain, at = _split(g, h, n) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:at], h[:at], n[:at], depth - 1), _tree(g[at:], h[at:], n[at:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best tree that cuts one side once and the other side once in each half."""
    best = (0.0, np.zeros_like(g))
    for flip in (False, True):
        a, b, c = (x.T if flip else x for x in (g, h, n))
        for at in range(1, a.shape[0]):
            value, gain = np.zeros_like(a), 0.0
            for rows in (slice(0, at), slice(at, None)):
                s, t, u = a[rows].sum(0), b[rows].sum(0), c[rows].sum(0)
                more, cut = _split(s, t, u)
                parts = (slice(0, cut), slice(cut, None)) if more > 1e-9 else (slice(None),)
                for p in parts:
                    v = s[p].sum() / (t[p].sum() + 1)
                    gain += s[p].sum() * v
                    value[rows, p] = v
            gain -= a.sum() ** 2 / (b.sum() + 1)
            if gain > best[0]:
                best = (gain, value.T if flip else value)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost on a bounded sample; the number of sweeps is chosen on every fifth row, which the trees do not see."""
    k = x.shape[1]
    if len(y) == 0 or y.min() == y.max():  # nothing to learn from: the share of label 1, or a half
        share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return Model([np.zeros(0)] * k, float(np.log(share / (1 - share))), [np.zeros(1)] * k)
    held = np.arange(len(y)) % 5 == 0 if len(y) >= 100 else np.zeros(len(y), bool)
    seen = ~held
    check = held if held.any() else seen
    edges = [_cuts(x[seen, j], BINS) for j in range(k)]
    coarse = [_cuts(x[seen, j], PAIR_BINS) for j in range(k)]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    wide = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]
    share = np.clip(y[seen].mean(), 0.01, 0.99)
    start = float(np.log(share / (1 - share)))
    total = np.full(len(y), start)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return np.where(seen, y - p, 0.0), np.where(seen, p * (1 - p), 0.0)

    def loss():
        t = total[check]
        return float(np.mean(np.logaddexp(0, t) - y[check] * t))

    def sums(index, length, g, h):
        count = np.bincount(index, seen.astype(float), length)
        return np.bincount(index, g, length), np.bincount(index, h, length), count

    def boost(tables, step):
        """Sweep until the loss on the held rows has not fallen for five sweeps; keep the tables of the best."""
        nonlocal total
        best, late = (loss(), [t.copy() for t in tables], total.copy()), 0
        for _ in range(ROUNDS):
            for j in range(len(tables)):
                g, h = slopes()
                step(j, g, h)
            now = loss()
            if now < best[0] - 1e-6:
                best, late = (now, [t.copy() for t in tables], total.copy()), 0
            else:
                late += 1
                if late == 5:
                    break
        total = best[2]
        return best[1]

    tables = [np.zeros(len(e) + 1) for e in edges]

    def add_single(j, g, h):
        value = RATE * _tree(*sums(bins[j], len(tables[j]), g, h))
        tables[j] += value
        total[:] += value[bins[j]]

    tables = boost(tables, add_single)
    g, h = slopes()
    shape = [len(c) + 1 for c in coarse]
    flat = lambda a, b: wide[a] * shape[b] + wide[b]
    grid = lambda a, b, g, h: [s.reshape(shape[a], shape[b]) for s in sums(flat(a, b), shape[a] * shape[b], g, h)]
    ranked = sorted(((-_pair_tree(*grid(a, b, g, h))[0], a, b) for a in range(k) for b in range(a)), key=lambda r: r)
    pairs = [(a, b) for gain, a, b in ranked[:PAIRS] if gain < 0]
    pair_tables = [np.zeros((shape[a], shape[b])) for a, b in pairs]

    def add_pair(j, g, h):
        a, b = pairs[j]
        value = RATE * _pair_tree(*grid(a, b, g, h))[1]
        pair_tables[j] += value
        total[:] += value[wide[a], wide[b]]

    pair_tables = boost(pair_tables, add_pair)
    return Model(edges, start, tables, pairs, coarse, pair_tables)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out fold, smallest hashes of doc_id first.

    Labels without a quality or an id are ignored; a document with several labels counts once, with the largest.
    """
    usable = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(fold(F.col("doc_id"), 5) != 0)
    usable = usable.groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    picked = usable.orderBy(hash_order(F.col("doc_id"), "quality"), "doc_id").limit(sample)  # at most `sample` rows: may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(1).to_pylist())
            got = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), got, b.column(2)], names=["doc_id", "x", "y"])

    rows = texts.mapInArrow(run, "doc_id long, x array<double>, y double").toPandas()
    rows = rows.sort_values("doc_id", kind="stable").drop_duplicates("doc_id")
    x = np.array(rows.x.tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, rows.y.to_numpy(dtype=np.float64))


def scored(docs: DataFrame, model: Model, out: str = "__score", text: str = "text") -> DataFrame:
    """``docs`` with a score from 0 to 1 of each whole text; null counts as empty; other columns pass through."""

    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        parts = [model.score(features(t.iloc[i : i + 256])) for i in range(0, len(t), 256)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(out, score(F.col(text)))


def op1_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns of the quality classifier, one row per document."""
    got = scored(docs.select("doc_id", "text"), train(docs, labels), "score")
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
