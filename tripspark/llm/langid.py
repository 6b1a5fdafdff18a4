"""Language identification by interpolated Kneser-Ney character models, one per language.

Four-grams of all training texts are counted; lower orders use the number of distinct left neighbours, so they
follow from the four-grams. Discounts, probabilities and back-off weights are Spark joins and aggregates. The
n-grams themselves are kept, so the model grows with its texts: as sorted arrays up to `BROADCAST_GRAMS` entries, as
a table that texts are joined with beyond. A text gets the language of lowest cross-entropy per letter; thresholds
calibrated on training texts tell which texts fit no learned language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripspark.llm.common import fold, join_sized
from tripspark.session import checkpointed

ORDER = 4
#: A model of at most this many entries over all languages and orders (12 bytes each, 48 MB) is broadcast.
BROADCAST_GRAMS = 4_000_000
REJECTED = 0.005  # share of a language's own training texts beyond its threshold
FEW = 200  # texts, below which that point is just the largest of them
RANKS = 10_000  # a threshold's rank is right to one part in so many of a language's texts
SHARPNESS = 20.0  # letters' worth of evidence in a score
PIECE = 2_000_000  # letters handled at once
UNKNOWN = "und"

_BREAK = re.compile(r"[\W\d_]+")
_MASKS = [0, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFFFFFF, 0xFFFFFFFFFFFFFFFF]


def grams(text: str | None) -> np.ndarray:
    """The packed four-grams (16 bits a letter) of a text's words in lower case; none without a letter."""
    flat = _BREAK.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, flat)):
        return np.zeros(0, dtype=np.uint64)
    codes = np.frombuffer(f"   {flat} ".encode("utf-16-le", "surrogatepass"), dtype="<u2").astype(np.uint64)
    return codes[:-3] << np.uint64(48) | codes[1:-2] << np.uint64(32) | codes[2:-1] << np.uint64(16) | codes[3:]


def count_grams(texts: DataFrame) -> DataFrame:
    """(lang, g, c) over all rows of (lang, text); sums are formed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def merge(lang):
            keys, counts = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
            sizes.pop(lang)
            if lang in held:
                both = np.concatenate([held[lang][0], keys])
                keys, place = np.unique(both, return_inverse=True)
                counts = np.bincount(place, np.concatenate([held[lang][1], counts]), len(keys)).astype(np.int64)
            held[lang] = keys, counts

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                g = grams(text.as_py())
                waiting.setdefault(lang, []).append(g)
                sizes[lang] = sizes.get(lang, 0) + len(g)
                if sizes[lang] > PIECE:
                    merge(lang)
        for lang in list(waiting):
            merge(lang)
        for lang, (keys, counts) in held.items():
            columns = [pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "g", "c"])

    found = texts.select("lang", "text").mapInArrow(run, "lang string, g long, c long")
    return found.groupBy("lang", "g").agg(F.sum("c").alias("c"))


def _tail(order: int):
    """The last ``order`` letters of a packed n-gram."""
    mask = _MASKS[order]
    return F.col("g").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def estimate(counts: DataFrame) -> DataFrame:
    """(lang, kind, key, value): kind k > 0 holds log probabilities of order k, kind -k log back-off weights."""
    types = {ORDER: checkpointed(counts)}
    for k in range(ORDER - 1, 0, -1):
        lower = types[k + 1].select("lang", _tail(k).alias("g")).groupBy("lang", "g").agg(F.count(F.lit(1)).alias("c"))
        types[k] = checkpointed(lower)
    below = types[1].groupBy("lang").agg((1 / (F.count(F.lit(1)) + 1)).alias("p0"))
    before = None
    parts = [below.select("lang", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key"), F.log("p0").alias("value"))]
    for k in range(1, ORDER + 1):
        n1, n2 = (F.sum((F.col("c") == i).cast("long")) for i in (1, 2))
        rate = F.when(n1 > 0, n1 / (n1 + 2 * n2)).otherwise(0.5)
        discount = types[k].groupBy("lang").agg(F.greatest(F.lit(0.1), F.least(F.lit(0.95), rate)).alias("d"))
        t = types[k].withColumn("ctx", F.shiftrightunsigned("g", 16)).withColumn("low", _tail(k - 1))
        context = t.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
        context = context.join(F.broadcast(discount), "lang")  # one row per language
        context = context.withColumn("gamma", F.col("d") * F.col("kinds") / F.col("total"))
        t = t.join(context, ["lang", "ctx"])
        if before is None:
            t = t.join(F.broadcast(below), "lang").withColumnRenamed("p0", "p_low")
        else:
            t = t.join(before.select("lang", F.col("g").alias("low"), F.col("p").alias("p_low")), ["lang", "low"])
        p = (F.col("c") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("p_low")
        before = checkpointed(t.select("lang", "g", p.alias("p")))
        parts.append(before.select("lang", F.lit(k).alias("kind"), F.col("g").alias("key"), F.log("p").alias("value")))
        parts.append(context.select("lang", F.lit(-k).alias("kind"), F.col("ctx").alias("key"), F.log("gamma").alias("value")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


@dataclass
class Model:
    langs: list[str]
    tables: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]  # (language, kind) -> sorted n-grams, values
    limits: dict[str, float] = field(default_factory=dict)
    stored: DataFrame | None = None  # the entries of a model too large for ``tables``

    def lookup(self, lang: str, kind: int, keys: np.ndarray) -> np.ndarray:
        """Values, not-a-number where the n-gram is not known."""
        known, values = self.tables.get((lang, kind), (np.zeros(0, np.uint64), np.zeros(0, np.float32)))
        if not len(known):
            return np.full(len(keys), np.nan)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, values[at].astype(np.float64), np.nan)

    def log_probability(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """Of the last letter of each four-gram after the three before it."""
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        for k in range(ORDER, 0, -1):
            k_keys = keys[todo] & np.uint64(_MASKS[k])
            got = self.lookup(lang, k, k_keys)
            hit = ~np.isnan(got)
            out[todo[hit]] += got[hit]
            todo, k_keys = todo[~hit], k_keys[~hit]
            out[todo] += np.nan_to_num(self.lookup(lang, -k, k_keys >> np.uint64(16)), nan=0.0)
        out[todo] += self.tables[lang, 0][1][0]
        return out

    def entropies(self, texts) -> np.ndarray:
        """Cross-entropy per letter of each text under each language; not-a-number without a letter."""
        result = np.full((len(texts), len(self.langs)), np.nan)
        part, uniques, size = [], [], 0
        for i, text in enumerate(texts):
            g = grams(text)
            if len(g):
                part.append((i, len(g)))
                uniques.append(np.unique(g, return_counts=True))
                size += len(uniques[-1][0])
            if part and (size > PIECE or i == len(texts) - 1):
                self._entropies(result, part, uniques)
                part, uniques, size = [], [], 0
        if part:
            self._entropies(result, part, uniques)
        return result

    def _entropies(self, result, part, uniques) -> None:
        keys = np.concatenate([u for u, _ in uniques])
        counts = np.concatenate([c for _, c in uniques])
        starts = np.concatenate([[0], np.cumsum([len(u) for u, _ in uniques])[:-1]])
        distinct = np.unique(keys)
        at = np.searchsorted(distinct, keys)
        rows = [i for i, _ in part]
        lengths = np.array([n for _, n in part])
        for j, lang in enumerate(self.langs):
            lp = self.log_probability(lang, distinct)
            result[rows, j] = -np.add.reduceat(lp[at] * counts, starts) / lengths


def collect_model(estimates: DataFrame, most: int = BROADCAST_GRAMS) -> Model:
    """Read the entries into arrays if they are at most ``most``, else leave them in their table."""
    stored = checkpointed(estimates.select("lang", "kind", "key", F.col("value").cast("float").alias("value")))
    langs = sorted(r.lang for r in stored.select("lang").distinct().collect())
    if stored.count() > most:
        return Model(langs, {}, stored=stored)
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) if langs else F.lit(0)
    rows = stored.select(number.cast("short").alias("lang"), F.col("kind").cast("short").alias("kind"), "key", "value").toArrow()
    number, kinds, keys, values = (c.to_numpy() for c in rows.columns)
    keys = keys.view(np.uint64)
    tables = {}
    for i, lang in enumerate(langs):
        for kind in range(-ORDER, ORDER + 1):
            at = np.flatnonzero((number == i + 1) & (kinds == kind))
            at = at[np.argsort(keys[at])]
            tables[lang, kind] = keys[at], values[at]
    return Model(langs, tables)


def _for_training() -> Column:
    """Rows with text and a language that is not null, outside the held-out fold."""
    return F.expr("lang IS NOT NULL AND text IS NOT NULL") & (F.coalesce(fold(F.col("doc_id"), 4), F.lit(0)) != 2)


def learn(docs: DataFrame) -> Model:
    """Count every training document; the model has no rejection thresholds yet."""
    return collect_model(estimate(count_grams(docs.filter(_for_training()).select("lang", "text"))))


def thresholds(told: DataFrame, langs: list[str]) -> dict[str, float]:
    """Rejection threshold of each language from (lang, pred, entropy) of all training texts.

    It is the 99.5 % point of the texts of the language that are taken for it. A language with fewer than `FEW` of
    them gets the larger of their largest and the point over the texts of all languages.
    """
    own = told.filter("lang = pred AND entropy IS NOT NULL AND NOT isnan(entropy)")
    point = F.percentile_approx("entropy", 1 - REJECTED, RANKS)  # a mergeable sketch: one row per language reaches the driver
    rows = own.rollup("lang").agg(point.alias("point"), F.max("entropy").alias("most"), F.count(F.lit(1)).alias("n")).collect()
    by = {r.lang: r for r in rows}
    if None not in by or by[None].n == 0:
        return {}
    shared, out = by[None].point, {}
    for lang in langs:
        r = by.get(lang)
        out[lang] = shared if r is None else r.point if r.n >= FEW else max(r.most, shared)
    return out


def train(docs: DataFrame) -> Model:
    """Learn from every training document and set the thresholds from all of them."""
    model = learn(docs)
    told = scored(docs.filter(_for_training()).select("lang", "text"), model)
    model.limits = thresholds(told.select("lang", "__lang.pred", "__lang.entropy"), model.langs)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with __lang: pred, score, entropy and rejected of each whole text.

    Null texts and texts without a letter are `UNKNOWN` with score 0; ties go to the first language by name; a
    model without a language answers `UNKNOWN` always. Other columns pass through.
    """
    if model.stored is not None:
        return _scored_by_join(docs, model)
    # plain values, so that workers need no copy of this package; bounded by BROADCAST_GRAMS
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.tables, model.limits))
    kind = "pred string, score double, entropy double, rejected boolean"

    @F.pandas_udf(kind)
    def judge(text: pd.Series) -> pd.DataFrame:
        m = Model(*shared.value)
        parts = []
        for s in range(0, len(text), 1024):
            texts = text.iloc[s : s + 1024].tolist()
            parts.append(_judged(m.entropies(texts) if m.langs else np.full((len(texts), 1), np.nan), m.langs, m.limits))
        return pd.concat(parts) if parts else _judged(np.zeros((0, 1)), [], {})

    return docs.withColumn("__lang", judge(F.col("text")))


def _judged(e: np.ndarray, langs: list[str], limits: dict[str, float]) -> pd.DataFrame:
    """Verdicts of texts from their cross-entropies, not-a-number for texts without a letter."""
    none = np.isnan(e).any(axis=1)
    filled = np.where(none[:, None], 0.0, e)
    best = filled.argmin(axis=1)
    low = filled.min(axis=1)
    score = 1 / np.exp(-SHARPNESS * (filled - low[:, None])).sum(axis=1)
    preds = [UNKNOWN if x else langs[j] for x, j in zip(none, best, strict=True)]
    outs = [bool(x) or bool(v > limits.get(n, np.inf)) for x, v, n in zip(none, low, preds, strict=True)]
    return pd.DataFrame({"pred": preds, "score": np.where(none, 0.0, score), "entropy": np.where(none, np.nan, low), "rejected": outs})


def joined_probabilities(wanted: DataFrame, model: Model) -> DataFrame:
    """(g, lp): what `Model.log_probability` gives for each distinct four-gram ``g`` under every language, by joins."""
    got = wanted
    for k in range(ORDER, 0, -1):
        for kind, key in ((k, _tail(k)), (-k, F.shiftrightunsigned(_tail(k), 16))):
            entries = F.map_from_entries(F.collect_list(F.struct("lang", "value"))).alias(f"m{kind}")
            side = model.stored.filter(F.col("kind") == kind).groupBy(F.col("key").alias("__key")).agg(entries)
            if k - (kind < 0) < 2:
                side = F.broadcast(side)  # at most 65,536 letters
            got = got.join(side, key == F.col("__key"), "left").drop("__key")
    last = {r.lang: r.value for r in model.stored.filter("kind = 0").collect()}  # one row per language

    def lp(lang: str):
        out = F.lit(last[lang]).cast("double")
        for k in range(1, ORDER + 1):
            known, gamma = (F.try_element_at(F.col(f"m{i}"), F.lit(lang)).cast("double") for i in (k, -k))
            out = F.coalesce(known, F.coalesce(gamma, F.lit(0.0)) + out)
        return out

    return got.select("g", F.array(*map(lp, model.langs)).alias("lp"))


def _scored_by_join(docs: DataFrame, model: Model) -> DataFrame:
    """`scored` for a model beyond the broadcast bound: the n-grams of every text meet the model's in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sig, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                g, c = np.unique(grams(text.as_py()), return_counts=True)
                columns = [pa.array(np.full(len(g), sig, np.int64)), pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["sig", "g", "c"])

    langs, limits = model.langs, model.limits
    held = docs.select(F.xxhash64("text").alias("sig"), "text").mapInArrow(run, "sig long, g long, c long")
    # the large side is on the left, so a frequent n-gram can be split; equal texts fall together, which leaves means as they are
    met = held.join(joined_probabilities(held.select("g").distinct(), model), "g", "left")
    sums = [F.sum(F.col("c") * F.col("lp")[i]) / F.sum("c") for i in range(len(langs))]
    means = met.groupBy("sig").agg(F.array(*[-x for x in sums]).alias("__e")).select(F.col("sig").alias("__sig"), "__e")

    @F.pandas_udf("pred string, score double, entropy double, rejected boolean")
    def judge(e: pd.Series) -> pd.DataFrame:
        rows = [x if x is not None else [np.nan] * len(langs) for x in e]
        return _judged(np.array(rows, dtype=np.float64).reshape(len(rows), len(langs)), langs, limits)

    joined = join_sized(docs, means, F.xxhash64(docs["text"]) == F.col("__sig"), "left")
    return joined.withColumn("__lang", judge(F.col("__e"))).drop("__sig", "__e")


def op10_language(docs: DataFrame) -> DataFrame:
    """Contract columns of language identification; ``rejected`` marks texts that fit no learned language."""
    rows = docs.select("doc_id", "text", "lang")
    model = learn(rows)
    # every text is scored once, for the thresholds and for the result
    told = scored(rows, model).select("doc_id", "lang", _for_training().alias("learned"), "__lang.pred", "__lang.score", "__lang.entropy")
    told = checkpointed(told)
    limits = thresholds(told.filter("learned"), model.langs)
    beyond = F.lit(False)
    if limits:
        limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
        beyond = F.coalesce(F.col("entropy") > F.try_element_at(limit, F.col("pred")), F.lit(False))
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return told.select(
        "doc_id",
        held.alias("held_out"),
        F.col("pred").alias("lang_pred"),
        "score",
        ((F.col("score") == 0) | beyond).alias("rejected"),  # score 0: no letter, or no language learned
    )
