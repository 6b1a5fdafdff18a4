"""Many fixed-effects regressions at once: outcomes × specifications × groups in one set of jobs.

All models share one table of rows, one table of vectors keyed by (model, effect, level), and the steps of one
conjugate-gradient solve. Rows that lack a value of a model are left out of that model alone, so panels may have gaps.
Only matrices of regressor size come to the driver, a few numbers for each model.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripspark.functions import tails
from tripspark.operators.fixed_effects import MAX_STEPS, TOLERANCE
from tripspark.session import checkpointed


@dataclass(frozen=True)
class Spec:
    """A specification: regressors, fixed effects (the first, with the most levels, is absorbed), cluster, weight."""

    name: str
    xs: tuple[str, ...]
    fes: tuple[str, ...]
    cluster: str
    w: str | None = None


def stacked(panel: DataFrame, outcomes: Sequence[str], specs: Sequence[Spec], by: Sequence[str] = ()) -> DataFrame:
    """One row for each row of ``panel`` and model that has all its values there.

    Columns: model, by, outcome, spec, f0.. (levels as text, NULL where a specification has fewer effects), cluster, w,
    x0 (the outcome), x1.. (regressors, 0 where a specification has fewer).
    """
    most_x, most_f = max(len(s.xs) for s in specs), max(len(s.fes) for s in specs)
    inputs = list(dict.fromkeys([c for s in specs for c in (*s.xs, *s.fes, s.cluster, *([s.w] if s.w else []))]))
    long = F.inline(F.array(*[F.struct(F.lit(y).alias("outcome"), F.col(y).cast("double").alias("x0")) for y in outcomes]))
    base = panel.select(*[F.col(c).alias(f"_b_{c}") for c in by], *[F.col(c).alias(f"_i_{c}") for c in inputs], long).where("x0 IS NOT NULL")

    def one(s: Spec):
        used = dict.fromkeys([*s.xs, *s.fes, s.cluster, *([s.w] if s.w else [])])
        ok = F.lit(True)
        for c in used:
            ok = ok & F.col(f"_i_{c}").isNotNull()
        effects = [F.col(f"_i_{f}").cast("string") for f in s.fes] + [F.lit(None).cast("string")] * (most_f - len(s.fes))
        regressors = [F.col(f"_i_{x}").cast("double") for x in s.xs] + [F.lit(0.0)] * (most_x - len(s.xs))
        return F.struct(
            F.lit(s.name).alias("spec"),
            ok.alias("ok"),
            *[e.alias(f"f{i}") for i, e in enumerate(effects)],
            F.col(f"_i_{s.cluster}").cast("string").alias("cluster"),
            (F.col(f"_i_{s.w}").cast("double") if s.w else F.lit(1.0)).alias("w"),
            *[x.alias(f"x{i + 1}") for i, x in enumerate(regressors)],
        )

    rows = base.select(*[c for c in base.columns if not c.startswith("_i_")], F.inline(F.array(*map(one, specs)))).where("ok AND w > 0").drop("ok")
    rows = rows.withColumnsRenamed({f"_b_{c}": c for c in by})
    return rows.withColumn("model", F.to_json(F.struct(*by, "outcome", "spec")))


def _names(rows: DataFrame, letter: str) -> list[str]:
    return sorted((c for c in rows.columns if c[0] == letter and c[1:].isdigit()), key=lambda c: int(c[1:]))


def _within(rows: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Subtract the weighted means of each (model, f0)."""
    means = rows.groupBy("model", "f0").agg(*[(F.sum(F.col("w") * F.col(x)) / F.sum("w")).alias(f"_m_{x}") for x in xs])
    return rows.join(means, ["model", "f0"]).withColumns({x: F.col(x) - F.col(f"_m_{x}") for x in xs}).drop(*[f"_m_{x}" for x in xs])


def _by_level(rows: DataFrame, fs: Sequence[str], sums: dict) -> DataFrame:
    """(model, fe, level, sums) over all effects but the absorbed one, in one shuffle."""
    pairs = F.inline(F.array(*[F.struct(F.lit(f).alias("fe"), F.col(f).alias("level")) for f in fs]))
    names = list(sums)
    cells = rows.select("model", *[v.alias(n) for n, v in sums.items()], pairs).where("level IS NOT NULL")
    return cells.groupBy("model", "fe", "level").agg(*[F.sum(n).alias(n) for n in names])


def _add_levels(rows: DataFrame, state: DataFrame, fs: Sequence[str], xs: Sequence[str], value: str, out: str) -> DataFrame:
    """``out`` + x: the sum over the effects of a row of the vectors ``value`` + x."""
    for f in fs:
        side = state.where(F.col("fe") == f).select("model", F.col("level").alias(f), *[F.col(value + x).alias(f"_{f}_{x}") for x in xs])
        rows = rows.join(side, ["model", f], "left")
    total = {out + x: sum((F.coalesce(F.col(f"_{f}_{x}"), F.lit(0.0)) for f in fs), F.lit(0.0)) for x in xs}
    return rows.withColumns(total).drop(*[f"_{f}_{x}" for f in fs for x in xs])


def _per_model(df: DataFrame, values: dict) -> dict[str, np.ndarray]:
    """One short vector for each model."""
    found = df.groupBy("model").agg(*[F.sum(v).alias(n) for n, v in values.items()]).collect()
    return {r.model: np.array([r[n] or 0.0 for n in values]) for r in found}


def _table(df: DataFrame, vectors: dict[str, np.ndarray], names: Sequence[str]) -> DataFrame:
    """Vectors of the driver as a table of one row for each model, small by nature."""
    rows = [(m, *map(float, v)) for m, v in vectors.items()]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "model string, " + ", ".join(f"{n} double" for n in names)))


def demeaned(rows: DataFrame, tol: float = TOLERANCE, max_steps: int = MAX_STEPS) -> DataFrame:
    """``rows`` of `stacked` with all fixed effects of each model removed from x0, x1.."""
    xs, fs = _names(rows, "x"), _names(rows, "f")[1:]
    within = _within(rows, xs)
    if not fs:
        return within
    k = len(xs)
    cells = checkpointed(rows.groupBy("model", "f0", *fs).agg(F.sum("w").alias("w")))
    right = _by_level(within, fs, {f"r{x}": F.col("w") * F.col(x) for x in xs})
    state = right.join(_by_level(cells, fs, {"d": F.col("w")}), ["model", "fe", "level"])
    state = checkpointed(state.withColumns({f"u{x}": F.lit(0.0) for x in xs} | {f"p{x}": F.col(f"r{x}") / F.col("d") for x in xs}))
    rz = start = _per_model(state, {x: F.col(f"r{x}") * F.col(f"p{x}") for x in xs})
    for _ in range(max_steps):
        todo = {m: v > tol**2 * start[m] for m, v in rz.items()}
        if not any(t.any() for t in todo.values()):
            break
        # the matrix times p, as a join of cells with levels, means by absorbed effect, and sums by level
        z = _add_levels(cells, state, fs, xs, "p", "z")
        means = z.groupBy("model", "f0").agg(*[(F.sum(F.col("w") * F.col(f"z{x}")) / F.sum("w")).alias(f"m{x}") for x in xs])
        product = _by_level(z.join(means, ["model", "f0"]), fs, {f"a{x}": F.col("w") * (F.col(f"z{x}") - F.col(f"m{x}")) for x in xs})
        state = checkpointed(state.join(product, ["model", "fe", "level"]))
        curve = _per_model(state, {x: F.col(f"p{x}") * F.col(f"a{x}") for x in xs})
        step = {m: np.divide(rz[m], c, out=np.zeros(k), where=(c > 0) & todo[m]) for m, c in curve.items()}
        moved = state.join(_table(state, step, [f"s{x}" for x in xs]), "model")
        moved = moved.withColumns(
            {f"u{x}": F.col(f"u{x}") + F.col(f"s{x}") * F.col(f"p{x}") for x in xs} | {f"r{x}": F.col(f"r{x}") - F.col(f"s{x}") * F.col(f"a{x}") for x in xs}
        )
        new = _per_model(moved, {x: F.col(f"r{x}") * F.col(f"r{x}") / F.col("d") for x in xs})
        turn = {m: np.divide(new[m], rz[m], out=np.zeros(k), where=(rz[m] > 0) & (step[m] > 0)) for m in rz}
        rz = {m: np.where(step[m] > 0, new[m], 0.0) for m in rz}
        turned = moved.join(_table(state, turn, [f"t{x}" for x in xs]), "model")
        turned = turned.withColumns({f"p{x}": F.col(f"r{x}") / F.col("d") + F.col(f"t{x}") * F.col(f"p{x}") for x in xs})
        state = turned.drop(*[f"{c}{x}" for c in "ast" for x in xs])
    else:
        raise RuntimeError(f"the fixed effects have not converged after {max_steps} steps")
    whole = _add_levels(rows, state, fs, xs, "u", "v")
    return _within(whole.withColumns({x: F.col(x) - F.col(f"v{x}") for x in xs}).drop(*[f"v{x}" for x in xs]), xs)


def fe_ols_batch(panel: DataFrame, outcomes: Sequence[str], specs: Sequence[Spec], by: Sequence[str] = (), only: Column | None = None) -> DataFrame:
    """Coefficients with clustered errors of every model: (by, outcome, spec, term, coef, se, t, p, n_obs, n_clusters).

    ``only`` picks models, as a condition on the columns by, outcome and spec; all combinations are fitted without it.
    A model without a row, or whose regressors the effects take up, gives no coefficient (NULL).
    """
    spark = panel.sparkSession
    known = {s.name: s for s in specs}
    rows = stacked(panel, outcomes, specs, by)
    rows = checkpointed(rows if only is None else rows.where(only))
    xs, fs = _names(rows, "x"), _names(rows, "f")
    res = checkpointed(demeaned(rows))
    k = len(xs)
    half = [(i, j) for i in range(k) for j in range(i, k)]
    sums = res.groupBy("model").agg(
        *[F.first(c).alias(c) for c in (*by, "outcome", "spec")],
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("cluster").alias("g"),
        *[F.countDistinct(f).alias(f) for f in fs],
        *[F.sum(F.col("w") * F.col(xs[i]) * F.col(xs[j])).alias(f"c{i}_{j}") for i, j in half],
    )
    plain = _per_model(rows, {x: F.col("w") * F.col(x) * F.col(x) for x in xs})  # of the raw columns, to tell what is left of them
    told = {r.model: r for r in sums.collect()}
    inverse, b = {}, {}
    for m, r in told.items():
        s = np.zeros((k, k))
        for i, j in half:
            s[i, j] = s[j, i] = r[f"c{i}_{j}"] or 0.0
        used = [j for j in range(1, k) if s[j, j] > 1e-12 * max(plain[m][j], 1e-300)]
        inverse[m] = np.zeros((k - 1, k - 1))
        if used:
            inverse[m][np.ix_([j - 1 for j in used], [j - 1 for j in used])] = np.linalg.pinv(s[np.ix_(used, used)], hermitian=True)
        b[m] = inverse[m] @ s[1:, 0]
    if not told:
        return spark.createDataFrame([], _schema(panel, by))
    e = F.col("x0") - sum((F.col(f"b{j}") * F.col(xs[j]) for j in range(1, k)), F.lit(0.0))
    scored = res.join(_table(res, b, [f"b{j}" for j in range(1, k)]), "model")
    scores = scored.groupBy("model", "cluster").agg(*[F.sum(F.col("w") * F.col(xs[j]) * e).alias(f"s{j}") for j in range(1, k)])
    pairs = [(i, j) for i in range(1, k) for j in range(i, k)]
    meat = _per_model(scores, {f"{i}_{j}": F.col(f"s{i}") * F.col(f"s{j}") for i, j in pairs})
    out = []
    for m, r in told.items():
        spec = known[r.spec]
        middle = np.zeros((k - 1, k - 1))
        for (i, j), v in zip(pairs, meat[m], strict=True):
            middle[i - 1, j - 1] = middle[j - 1, i - 1] = v
        levels = sum(r[f] for f in fs[: len(spec.fes)]) - (len(spec.fes) - 1)
        adjust = r.g / (r.g - 1) * (r.n - 1) / max(r.n - len(spec.xs) - levels, 1) if r.g > 1 else float("nan")
        v = adjust * inverse[m] @ middle @ inverse[m]
        for j, term in enumerate(spec.xs):
            if inverse[m][j, j] <= 0:
                out.append((*[r[c] for c in by], r.outcome, r.spec, term, None, None, None, None, r.n, r.g))
                continue
            se = float(np.sqrt(max(v[j, j], 0.0)))
            t = float(b[m][j]) / se if se > 0 else None
            out.append((*[r[c] for c in by], r.outcome, r.spec, term, float(b[m][j]), se, t, tails.t_two_sided(t, r.g - 1), r.n, r.g))
    return spark.createDataFrame(out, _schema(panel, by))


def _schema(panel: DataFrame, by: Sequence[str]) -> str:
    kinds = dict(panel.dtypes)
    return ", ".join([*(f"{c} {kinds[c]}" for c in by), "outcome string, spec string, term string, coef double, se double, t double, p double, n_obs long, n_clusters long"])
