"""Mixing sources to target weights by iterative proportional fitting.

Token sums of all documents are counted by source, language and topic. Factors of the three marginals are fitted in
turn until every marginal of the weighted tokens has its target share. A document is then kept with probability
proportional to the product of its factors, so the expected tokens of the sample have the target shares.

A source row holds the token sums of its language and topic cells, so the factor of a source needs its own row only,
and one sweep is one aggregate of a sum for each language and topic. Sources may be many; languages and topics few.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripspark.llm.common import SPACES, join_sized
from tripspark.session import checkpointed

SEED = 11
#: Default targets are the marginals of the corpus, tempered by these powers.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.7}
#: No category is weighted by default above so many times the largest one: else a nearly empty category would set the
#: scale of all probabilities, and little of the corpus would be left.
UPLIFT = 1.5
TOLERANCE = 1e-9  # of a marginal share, relative
SWEEPS = 500  # a fit that has not converged by then, or has not come closer for `STALLED` sweeps, says so in the log
STALLED = 20  # and uses the closest factors

_log = logging.getLogger(__name__)


def token_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")).cast("long")


def form_topic(text: Column) -> Column:
    """The topic used where a table has none: the form of the whole text."""
    whole = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(whole), F.lit(1))
    count = lambda c: F.length(whole) - F.length(F.replace(whole, F.lit(c), F.lit("")))
    return (
        F.when(F.length(F.trim(whole)) == 0, "empty")
        .when(count("|") * 50 > size, "table")
        .when(count("\n") * 40 > size, "list")
        .when(size >= 6000, "long prose")
        .when(size >= 1500, "prose")
        .otherwise("short prose")
    )


@dataclass
class Factors:
    sources: DataFrame  # source, factor
    cells: dict[tuple[str, str], float]  # language and topic
    scale: float  # the largest product of factors is 1 after it
    converged: bool


def _tempered(sums: dict[str, float], power: float) -> dict[str, float]:
    held = {k: v for k, v in sums.items() if v > 0}
    top = max(held.values())
    raw = {k: v * min((v / top) ** (power - 1), UPLIFT) for k, v in held.items()}
    whole = sum(raw.values())
    return {k: v / whole for k, v in raw.items()}


def _shares(targets: dict[str, float] | None, sums: dict[str, float], power: float) -> dict[str, float]:
    """Target shares of the categories that have tokens; unnamed categories get nothing."""
    if targets is None:
        return _tempered(sums, power)
    named = {k: v for k, v in targets.items() if sums.get(k, 0) > 0 and v > 0}
    whole = sum(named.values())
    return {k: v / whole for k, v in named.items()}


def rake(cells: DataFrame, source_targets: dict | None = None, lang_targets: dict | None = None, topic_targets: dict | None = None) -> Factors | None:
    """Fit factors to (source, lang, topic, tokens); None if there are no tokens.

    Targets are shares by category and default to tempered marginals. Categories without a target are weighted 0.
    """
    cells = checkpointed(cells.filter("tokens > 0"))
    pairs = {(r.lang, r.topic): float(r.tokens) for r in cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).collect()}
    if not pairs:
        return None
    keys = sorted(pairs)
    whole = sum(pairs.values())
    by = lambda i: {k: sum(v for p, v in pairs.items() if p[i] == k) for k in {p[i] for p in pairs}}
    t_lang, t_topic = _shares(lang_targets, by(0), TEMPER["lang"]), _shares(topic_targets, by(1), TEMPER["topic"])

    entry = F.struct(F.concat_ws("\x1f", "lang", "topic").alias("k"), (F.col("tokens") / whole).alias("v"))
    packed = cells.groupBy("source").agg(F.map_from_entries(F.collect_list(entry)).alias("m"), (F.sum("tokens") / whole).alias("share"))
    base = F.array(*[F.coalesce(F.element_at("m", F.lit("\x1f".join(k))), F.lit(0.0)) for k in keys])
    rows = packed.select("source", "share", base.alias("base"))
    if source_targets is None:
        top = rows.agg(F.max("share")).first()[0]
        raw = F.col("share") * F.least(F.pow(F.col("share") / top, F.lit(TEMPER["source"] - 1)), F.lit(UPLIFT))
        total = rows.agg(F.sum(raw)).first()[0]
        rows = rows.withColumn("target", raw / total)
    else:
        flat = [x for k, v in source_targets.items() for x in (F.lit(k), F.lit(float(v)))]
        rows = rows.withColumn("target", F.coalesce(F.element_at(F.create_map(*flat), F.col("source")), F.lit(0.0)) if flat else F.lit(0.0))
        total = rows.agg(F.sum("target")).first()[0]
        if not total:
            return None
        rows = rows.withColumn("target", F.col("target") / total)
    rows = checkpointed(rows)

    f_lang = {k: float(k in t_lang) for k, _ in keys}
    f_topic = {k: float(k in t_topic) for _, k in keys}
    product = lambda: np.array([f_lang[a] * f_topic[b] for a, b in keys])

    def source_factor(f: np.ndarray) -> Column:
        weights = F.array(*[F.lit(float(x)) for x in f])
        z = F.aggregate(F.zip_with("base", weights, lambda b, w: b * w), F.lit(0.0), lambda a, x: a + x)
        return F.when(z > 0, F.col("target") / z).otherwise(0.0)

    converged, closest, late, f = False, np.inf, 0, product()
    for _ in range(SWEEPS):
        tried = product()
        if not np.isfinite(tried).all():
            break
        fitted = rows.withColumn("fs", source_factor(tried))
        sums = fitted.agg(*[F.sum(F.col("fs") * F.col("base")[i]).alias(f"s{i}") for i in range(len(keys))]).first()
        now = np.array([sums[i] or 0.0 for i in range(len(keys))]) * tried
        worst = 0.0
        for i, (factor, target) in enumerate(((f_lang, t_lang), (f_topic, t_topic))):
            for k, share in target.items():
                places = [j for j, key in enumerate(keys) if key[i] == k]
                have = now[places].sum()
                if have > 1e-200:
                    ratio = share / have
                    worst = max(worst, abs(ratio - 1))
                    factor[k] *= ratio
                    now[places] *= ratio
        for factor in (f_lang, f_topic):  # the source factors take up the common size
            top = max(factor.values())
            factor.update({k: v / top for k, v in factor.items()} if top > 0 else {})
        late = 0 if worst < 0.999 * closest else late + 1
        if worst < closest:
            closest, f = worst, tried
        if worst < TOLERANCE:
            converged, f = True, product()
            break
        if late == STALLED:
            break
    if not converged:
        _log.warning("raking stopped %g from its targets; they may exclude each other", closest)
    final = checkpointed(rows.select("source", source_factor(f).alias("factor"), "base"))
    used = [F.max(F.when(F.col("base")[i] > 0, F.col("factor") * float(f[i]))) for i in range(len(keys))]
    tops = [x for x in final.agg(*used).first() if x]
    return Factors(final.select("source", "factor"), dict(zip(keys, f.tolist(), strict=True)), 1 / max(tops) if tops else 0.0, converged)


def mixed(
    docs: DataFrame,
    topic: Column | None = None,
    source_targets: dict | None = None,
    lang_targets: dict | None = None,
    topic_targets: dict | None = None,
    seed: int = SEED,
    id_col: str = "doc_id",
) -> DataFrame:
    """``docs`` with __mix: topic, tokens, probability and kept.

    Null sources and languages are the category "". Null and empty texts have no tokens, add nothing to a marginal
    and keep the probability of their cell, or 0 if it has no tokens. The draw is a hash of seed and id (of the
    text where the id is null): equal rows are kept or left together. Other columns pass through.
    """
    topic = form_topic(F.col("text")) if topic is None else topic
    tagged = docs.withColumns(
        {
            "__source": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "__l": F.coalesce(F.col("lang").cast("string"), F.lit("")),
            "__t": F.coalesce(topic, F.lit("")),
            "__n": token_count(F.col("text")),
        }
    )
    cells = tagged.groupBy(F.col("__source").alias("source"), F.col("__l").alias("lang"), F.col("__t").alias("topic"))
    factors = rake(cells.agg(F.sum("__n").alias("tokens")), source_targets, lang_targets, topic_targets)
    if factors is None:
        p = F.lit(0.0)
    else:
        flat = [x for (a, b), v in factors.cells.items() for x in (F.lit(f"{a}\x1f{b}"), F.lit(v * factors.scale))]
        tagged = join_sized(tagged, factors.sources.select(F.col("source").alias("__source"), F.col("factor").alias("__f")), "__source", "left")
        p = F.least(F.lit(1.0), F.coalesce(F.element_at(F.create_map(*flat), F.concat_ws("\x1f", "__l", "__t")) * F.col("__f"), F.lit(0.0)))
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.when(F.col(id_col).isNull(), F.col("text")))
    draw = F.shiftrightunsigned(key, 11).cast("double") * 2.0**-53
    tagged = tagged.withColumn("__p", p)
    mix = F.struct(F.col("__t").alias("topic"), F.col("__n").alias("tokens"), F.col("__p").alias("probability"), (draw < F.col("__p")).alias("kept"))
    return tagged.withColumn("__mix", mix).select(*docs.columns, "__mix")


def op2_mixing(docs: DataFrame) -> DataFrame:
    """Every document with its topic, tokens, calibrated probability and whether it is in the sample."""
    got = mixed(docs.select("doc_id", "text", "lang", "source"))
    return got.select("doc_id", "source", "lang", "__mix.*")
