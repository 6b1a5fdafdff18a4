"""The long pre-period: monthly effects, placebo year, trend specifications and bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripspark.config import SEED
from tripspark.operators import contrasts, longrun
from tripspark.plans.causal import difference_sql, long_sql
from tripspark.plans.inference import _WEBB, u_sql
from tripspark.plans.registry import query
from tripspark.session import checkpointed

OUT = ["ln_n", "mph", "rider_ex_pt"]
MONTHS = longrun.months_between(2022, 2025)
DRAWS = 1999
GRID = (0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0)
FINE = [round(0.005 * i, 3) for i in range(601)]


def values_sql(terms: dict[str, dict[str, float]]) -> str:
    rows = ", ".join(f"('{t}', '{m}', {a!r})" for t, by in terms.items() for m, a in by.items())
    return f"SELECT term, ym, CAST(a AS DOUBLE) AS a FROM (VALUES {rows}) AS v(term, ym, a)"


def term_contrasts(t, terms, outcomes=OUT):
    panel = t.panel_long
    weights = contrasts.weights_frame(t.spark, "ym", panel.schema["ym"].dataType, terms)
    return contrasts.unit_contrasts(panel, "zone", "ym", outcomes, weights, ["treat"], len(MONTHS))


_LONG = {"lg": long_sql("panel_long", OUT, "zone, ym, treat")}


def _contrast_ctes(name: str, terms: dict) -> dict[str, str]:
    return {
        **_LONG,
        f"{name}_w": values_sql(terms),
        f"{name}_c": f"SELECT outcome, term, zone AS cluster, treat, 1.0e0 AS w, sum(a * y) AS c FROM lg JOIN {name}_w USING (ym) GROUP BY ALL",
    }


_EFFECTS = longrun.effect_terms(MONTHS)
_SUMMARY = longrun.summary_terms(MONTHS)
_SPEC = longrun.spec_terms(MONTHS)
_K = str(len(_EFFECTS))
_le_ctes, _le_final = difference_sql("le_c", "outcome term", "48", _K, "23")


@query("long_event_study", f"SELECT outcome, term AS ym, coef, se, n_obs, n_clusters FROM ({_le_final})", "coef se", {**_contrast_ctes("le", _EFFECTS), **_le_ctes})
def long_event_study(t):
    """Effects of 36 months against the same month of the base year."""
    c = term_contrasts(t, _EFFECTS)
    return contrasts.estimate(c, ["outcome", "term"], 48, k=len(_EFFECTS), extra_levels=23).select("outcome", F.col("term").alias("ym"), "coef", "se", "n_obs", "n_clusters")


_ls_ctes, _ls_final = difference_sql("ls_c", "outcome term", "48", _K, "23")


@query("long_summary", f"SELECT outcome, term, coef, se, t FROM ({_ls_final})", "coef se t:4", {**_contrast_ctes("ls", _SUMMARY), **_ls_ctes})
def long_summary(t):
    """Placebo year, effect, acceleration, trend-adjusted effect and slope."""
    c = term_contrasts(t, _SUMMARY)
    return contrasts.estimate(c, ["outcome", "term"], 48, k=len(_EFFECTS), extra_levels=23).select("outcome", "term", "coef", "se", "t")


@query("long_wald")
def long_wald(t):
    """Joint tests that the monthly effects before the policy are all equal."""
    import numpy as np

    pre = [m for m in longrun.event_months(MONTHS, longrun.SPECS["S1"]) if m < "2025"]
    last = _EFFECTS[pre[-1]]
    terms = {}
    for m in pre[:-1]:
        w = dict(_EFFECTS[m])
        for q, a in last.items():
            w[q] = w.get(q, 0.0) - a
        terms[m] = w
    c = term_contrasts(t, terms)
    est = {(r["outcome"], r["term"]): r["coef"] for r in contrasts.estimate(c, ["outcome", "term"], 48).collect()}
    cov = contrasts.covariance(c, "outcome", 48, k=len(_EFFECTS) + 23).collect()
    rows = []
    for y in sorted({o for o, _ in est}):
        names = sorted(terms)
        at = {a: i for i, a in enumerate(names)}
        v = np.zeros((len(names), len(names)))
        for r in cov:
            if r["outcome"] == y:
                v[at[r["a"]], at[r["b"]]] = r["v"]
        stat, rank, p = contrasts.wald(np.array([est[y, a] for a in names]), v)
        rows.append((y, stat, rank, p))
    return t.spark.createDataFrame(rows, "outcome string, wald double, dof int, p double")


_T = {s: len(longrun.sample_months(MONTHS, x)) for s, x in longrun.SPECS.items()}
_KS = {s: len(longrun.event_months(MONTHS, x)) for s, x in longrun.SPECS.items()}
_XS = {s: 2 * (12 - len(x.drop)) - 1 for s, x in longrun.SPECS.items()}


def _case(d: dict, column: str = "term") -> str:
    return "(CASE " + column + "".join(f" WHEN '{k}' THEN {v}" for k, v in d.items()) + " END)"


_ts_ctes, _ts_final = difference_sql("ts_c", "outcome term", _case(_T), _case(_KS), _case(_XS))
_DRAW_CTES = {
    "dr_v": f"SELECT draw, zone AS cluster, {_WEBB} AS v FROM (SELECT draw, zone, {u_sql(str(SEED + 7), 'draw', 'zone')} AS u FROM (SELECT DISTINCT zone FROM panel_long) CROSS JOIN (SELECT unnest(range(1, {DRAWS + 1})) AS draw))"
}


@query(
    "trend_specs",
    f"""SELECT term AS spec, outcome, coef, se, sd_b AS se_wild, 2 * coef - hi AS ci_low_wild, 2 * coef - lo AS ci_high_wild FROM ({_ts_final})
        JOIN (SELECT outcome, term, stddev_samp(b) AS sd_b, quantile_cont(b, 0.025) AS lo, quantile_cont(b, 0.975) AS hi FROM (
          SELECT s.outcome, s.term, draw, any_value(coef) + sum(v * s) AS b FROM df_s AS s JOIN dr_v USING (cluster) JOIN df_c USING (outcome, term) GROUP BY ALL) GROUP BY ALL) USING (outcome, term)""",
    "coef se se_wild ci_low_wild ci_high_wild",
    {**_contrast_ctes("ts", _SPEC), **_ts_ctes, **_DRAW_CTES},
)
def trend_specs(t):
    """The trend-adjusted effect under six choices of base year and trend, with bootstrap intervals."""
    c = term_contrasts(t, _SPEC)

    def by_spec(values):
        return F.expr(_case(values))

    est = contrasts.estimate(c, ["outcome", "term"], by_spec(_T), k=by_spec(_KS), extra_levels=by_spec(_XS))
    draws = longrun.bootstrap_draws(c, ["outcome", "term"], DRAWS, SEED + 7)
    boot = draws.groupBy("outcome", "term").agg(F.stddev_samp("b").alias("se_wild"), F.percentile("b", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    out = est.join(boot, ["outcome", "term"])
    return out.select(
        F.col("term").alias("spec"), "outcome", "coef", "se", "se_wild",
        (2 * F.col("coef") - F.col("q")[1]).alias("ci_low_wild"), (2 * F.col("coef") - F.col("q")[0]).alias("ci_high_wild"),
    )


_THETA = {"theta": _SUMMARY["effect_vs_last_pre"]}
_PRE = {m: w for m, w in _EFFECTS.items() if m < "2025"}
_rr1, _rrf1 = difference_sql("rp_c", "outcome term", "48", _K, "23", prefix="r1")
_rr2, _rrf2 = difference_sql("rt_c", "outcome term", "48", _K, "23", prefix="r2")
_RR = {**_contrast_ctes("rp", _PRE), **_rr1, **_contrast_ctes("rt", _THETA), **_rr2}
_RR["rr_worst"] = f"SELECT outcome, max(delta) AS max_pre_delta FROM (SELECT outcome, abs(coef - lag(coef) OVER (PARTITION BY outcome ORDER BY term)) AS delta FROM ({_rrf1})) GROUP BY outcome"


@query(
    "rr_bounds",
    f"""SELECT outcome, m, coef AS theta, se, max_pre_delta, coef - m * max_pre_delta * 6.5e0 AS set_low, coef + m * max_pre_delta * 6.5e0 AS set_high
        FROM ({_rrf2}) JOIN rr_worst USING (outcome) CROSS JOIN (SELECT unnest([{", ".join(f"{g}e0" for g in GRID)}]) AS m)""",
    "theta se max_pre_delta set_low set_high",
    _RR,
)
def rr_bounds(t):
    """Relative-magnitude bounds on the effect against the last pre-month."""
    est = contrasts.estimate(term_contrasts(t, {**_PRE, **_THETA}), ["outcome", "term"], 48, k=len(_EFFECTS), extra_levels=23)
    pre = est.where("term <> 'theta'").select("outcome", F.col("term").alias("ym"), "coef")
    return longrun.bounds(pre, est.where("term = 'theta'").select("outcome", "coef", "se"), GRID)


_RB = {
    **_RR,
    **_DRAW_CTES,
    "rb_beta": "SELECT s.outcome, s.term, draw, any_value(coef) + sum(v * s) AS b FROM r1_s AS s JOIN dr_v USING (cluster) JOIN r1_c USING (outcome, term) GROUP BY ALL",
    "rb_worst": "SELECT outcome, draw, max(delta) AS dmax FROM (SELECT outcome, draw, abs(b - lag(b) OVER (PARTITION BY outcome, draw ORDER BY term)) AS delta FROM rb_beta) GROUP BY ALL",
    "rb_theta": "SELECT s.outcome, draw, any_value(coef) AS theta, any_value(coef) + sum(v * s) AS b FROM r2_s AS s JOIN dr_v USING (cluster) JOIN r2_c USING (outcome, term) GROUP BY ALL",
}


def _sets_sql(grid) -> str:
    values = ", ".join(f"{g}e0" for g in grid)
    return f"""SELECT outcome, m, theta, quantile_cont(b - m * dmax * 6.5e0, 0.025) AS ci_low, quantile_cont(b + m * dmax * 6.5e0, 0.975) AS ci_high
        FROM rb_theta JOIN rb_worst USING (outcome, draw) CROSS JOIN (SELECT unnest([{values}]) AS m) GROUP BY outcome, m, theta"""


def bound_sets(t, grid):
    c = term_contrasts(t, {**_PRE, **_THETA})
    draws = longrun.bootstrap_draws(c, ["outcome", "term"], DRAWS, SEED + 7)
    effects = draws.where("term <> 'theta'").withColumnRenamed("term", "ym")
    return longrun.bootstrap_bounds(effects, draws.where("term = 'theta'").drop("term"), grid)


@query("rr_bootstrap", f"SELECT *, ci_low <= 0 AND ci_high >= 0 AS covers_zero FROM ({_sets_sql(GRID)})", "theta ci_low ci_high", _RB)
def rr_bootstrap(t):
    """Bootstrap confidence sets for the bounds."""
    return bound_sets(t, GRID)


@query("rr_breakdown", f"SELECT outcome, theta, min(m) FILTER (WHERE ci_low <= 0 AND ci_high >= 0) AS breakdown_m FROM ({_sets_sql(FINE)}) GROUP BY outcome, theta", "theta breakdown_m", _RB)
def rr_breakdown(t):
    """The smallest relative magnitude at which the confidence set reaches zero."""
    return longrun.breakdown(bound_sets(t, FINE))


@query(
    "long_index",
    """SELECT ym, treat, 100.0e0 * per_day / avg(per_day) FILTER (WHERE ym < '2023') OVER (PARTITION BY treat) AS idx FROM (
         SELECT ym, treat, sum(n) / any_value(CAST(day(last_day(CAST(ym || '-01' AS DATE))) AS DOUBLE)) AS per_day FROM panel_long GROUP BY ALL)""",
    "idx",
)
def long_index(t):
    """Trips per day by month, as percent of the base year's mean."""
    from tripspark.operators.timeops import index_to_base

    m = t.panel_long.groupBy("ym", "treat").agg(F.sum("n").alias("n"))
    days = F.dayofmonth(F.last_day(F.to_date(F.concat("ym", F.lit("-01")))))
    return index_to_base(m.withColumn("per_day", F.col("n") / days), "per_day", ["treat"], F.col("ym") < "2023").select("ym", "treat", "idx")




# ------------------------------------------------------------------ both restrictions
# The multiples and curvatures of the published tables.
BOOT_CHANGES = (0.0, 0.25, 0.5, 1.0, 1.5, 2.0)
BOOT_CURVATURES = (0.0, 0.05, 0.1, 0.25, 0.5, 1.0)
CURVATURES = (0.0, 0.0025, 0.005, 0.01, 0.02, 0.05)

_TWO = {f"{s}|{part}": w for s in ("S1", "S2") for part, w in longrun.restriction_terms(MONTHS, longrun.SPECS[s]).items()}
_BIAS = {s: longrun.bias_weights(MONTHS, longrun.SPECS[s]) for s in ("S1", "S2")}
_two1, _ = difference_sql("tw_c", "outcome term", "48", _K, "23", prefix="t1")
_TWO_CTES = {
    **_contrast_ctes("tw", _TWO),
    **_two1,
    **_DRAW_CTES,
    "tw_draw": """SELECT split_part(s.term, '|', 1) AS spec, split_part(s.term, '|', 2) AS part, s.outcome, draw, any_value(coef) AS coef, any_value(coef) + sum(v * s) AS b
        FROM t1_s AS s JOIN dr_v USING (cluster) JOIN t1_c USING (outcome, term) GROUP BY s.term, s.outcome, draw""",
    "tw_worst": """SELECT spec, outcome, draw, max(delta) AS dmax FROM (SELECT *, abs(b - lag(b) OVER (PARTITION BY spec, outcome, draw ORDER BY part)) AS delta
        FROM tw_draw WHERE part NOT LIKE 'theta%') GROUP BY ALL""",
    "tw_spread": "SELECT spec, outcome, stddev_samp(b) AS se_sd, quantile_cont(b, 0.025) AS lo, quantile_cont(b, 0.975) AS hi, any_value(coef) AS theta_sd FROM tw_draw WHERE part = 'theta_sd' GROUP BY ALL",
}


def _list_sql(values) -> str:
    return "unnest([" + ", ".join(f"{v}e0" for v in values) + "])"


def _rm_sql(grid) -> str:
    return f"""SELECT spec, outcome, 'RM' AS restriction, m, any_value(coef) AS theta, quantile_cont(b - m * dmax * w, 0.025) AS ci_low, quantile_cont(b + m * dmax * w, 0.975) AS ci_high
        FROM tw_draw JOIN tw_worst USING (spec, outcome, draw) JOIN (VALUES {", ".join(f"('{s}', {w[0]}e0)" for s, w in _BIAS.items())}) AS bias(spec, w) USING (spec)
        CROSS JOIN (SELECT {_list_sql(grid)} AS m) WHERE part = 'theta_rm' GROUP BY spec, outcome, m"""


def two_draws(t):
    c = term_contrasts(t, _TWO)
    draws = longrun.bootstrap_draws(c, ["outcome", "term"], DRAWS, SEED + 7)
    return draws.withColumns({"spec": F.split_part("term", F.lit("|"), F.lit(1)), "part": F.split_part("term", F.lit("|"), F.lit(2))}).drop("term")


@query(
    "restricted_sets",
    f"""SELECT *, ci_low <= 0 AND ci_high >= 0 AS covers_zero FROM ({_rm_sql(BOOT_CHANGES)} UNION ALL
        SELECT spec, outcome, 'SD', m, theta_sd, lo - m * se_sd, hi + m * se_sd FROM tw_spread CROSS JOIN (SELECT {_list_sql(BOOT_CURVATURES)} AS m))""",
    "theta ci_low ci_high",
    _TWO_CTES,
)
def restricted_sets(t):
    """Bootstrap sets under bounded changes and under bounded curvature, for two specifications."""
    return longrun.restricted_sets(two_draws(t), _BIAS, BOOT_CHANGES, BOOT_CURVATURES)


@query(
    "restricted_breakdown",
    f"""SELECT spec, outcome, breakdown_rm, theta_sd, se_sd, bias / w AS breakdown_sd, bias / se_sd AS breakdown_sd_rel_se FROM (
          SELECT *, CASE WHEN lo <= 0 AND hi >= 0 THEN 0.0e0 ELSE least(abs(lo), abs(hi)) END AS bias FROM tw_spread)
        JOIN (VALUES {", ".join(f"('{s}', {w[1]}e0)" for s, w in _BIAS.items())}) AS bias(spec, w) USING (spec)
        JOIN (SELECT spec, outcome, min(m) FILTER (WHERE ci_low <= 0 AND ci_high >= 0) AS breakdown_rm FROM ({_rm_sql(FINE)}) GROUP BY ALL) USING (spec, outcome)""",
    "breakdown_rm theta_sd se_sd breakdown_sd breakdown_sd_rel_se",
    _TWO_CTES,
)
def restricted_breakdown(t):
    """The multiple and the curvature at which either set reaches zero."""
    draws = checkpointed(two_draws(t))
    sets = longrun.restricted_sets(draws, _BIAS, FINE, (0.0,)).where("restriction = 'RM'")
    least = sets.groupBy("spec", "outcome").agg(F.min(F.when(F.col("covers_zero"), F.col("m"))).alias("breakdown_rm"))
    return least.join(longrun.curvature_breakdown(draws, _BIAS), ["spec", "outcome"])


_S1 = longrun.restriction_terms(MONTHS, longrun.SPECS["S1"])
_cr1, _crf1 = difference_sql("cr_c", "outcome term", "48", _K, "23", prefix="c1")
# the critical value of Student's t by bisection of its distribution, which Simpson's rule integrates from its middle
_CRITICAL = {
    **_contrast_ctes("cr", _S1),
    **_cr1,
    "cr_est": _crf1,
    "t_crit": """WITH RECURSIVE b(g, i, lo, hi) AS (SELECT DISTINCT n_clusters, 0, 0.0e0, 20.0e0 FROM cr_est UNION ALL
          SELECT g, i + 1, CASE WHEN area > 0.475 THEN lo ELSE mid END, CASE WHEN area > 0.475 THEN mid ELSE hi END FROM (
            SELECT *, (lo + hi) / 2 AS mid, exp(lgamma(g / 2.0e0) - lgamma((g - 1) / 2.0e0)) / sqrt((g - 1) * pi()) * (lo + hi) / 2400 *
              list_sum(list_transform(range(0, 401), lambda j: (CASE WHEN j IN (0, 400) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END)
                * pow(1 + pow(j * (lo + hi) / 800, 2) / (g - 1), -g / 2.0e0))) AS area FROM b) WHERE i < 50)
        SELECT g, (lo + hi) / 2 AS crit FROM b WHERE i = 50""",
    "cr_worst": """SELECT outcome, max(delta) AS dmax FROM (SELECT outcome, abs(coef - lag(coef) OVER (PARTITION BY outcome ORDER BY term)) AS delta
        FROM cr_est WHERE term NOT LIKE 'theta%') GROUP BY outcome""",
    "cr_unit": f"""SELECT outcome, 'RM' AS restriction, coef AS theta, se, crit, dmax * {_BIAS["S1"][0]}e0 AS unit FROM cr_est JOIN cr_worst USING (outcome) JOIN t_crit ON g = n_clusters WHERE term = 'theta_rm'
        UNION ALL SELECT outcome, 'SD', coef, se, crit, {_BIAS["S1"][1]}e0 FROM cr_est JOIN t_crit ON g = n_clusters WHERE term = 'theta_sd'""",
}


@query(
    "restricted_critical",
    f"""SELECT outcome, restriction, m, theta, se, m * unit AS bound, theta - m * unit - crit * se AS ci_low, theta + m * unit + crit * se AS ci_high,
          greatest((abs(theta) - crit * se) / unit, 0) AS breakdown FROM cr_unit
        JOIN (SELECT 'RM' AS restriction, {_list_sql(GRID)} AS m UNION ALL SELECT 'SD', {_list_sql(CURVATURES)}) USING (restriction)""",
    "theta se bound ci_low ci_high breakdown",
    _CRITICAL,
)
def restricted_critical(t):
    """Sets of both restrictions widened by the critical value of the clustered error, and where they reach zero."""
    est = contrasts.estimate(term_contrasts(t, _S1), ["outcome", "term"], 48, k=len(_EFFECTS), extra_levels=23)
    est = checkpointed(contrasts.with_p_values(est).withColumn("half", F.col("coef") - F.col("ci_low")))
    worst = longrun.largest_change(est.where("NOT startswith(term, 'theta')").withColumnRenamed("term", "ym"), ["outcome"], "coef")
    rm = est.where("term = 'theta_rm'").join(worst, "outcome").withColumns({"restriction": F.lit("RM"), "unit": F.col("dmax") * _BIAS["S1"][0]}).drop("dmax")
    sd = est.where("term = 'theta_sd'").withColumns({"restriction": F.lit("SD"), "unit": F.lit(_BIAS["S1"][1])})
    grid = F.when(F.col("restriction") == "RM", F.array(*map(F.lit, GRID))).otherwise(F.array(*map(F.lit, CURVATURES)))
    rows = rm.unionByName(sd).withColumn("m", F.explode(grid))
    bound = F.col("m") * F.col("unit")
    return rows.select(
        "outcome", "restriction", "m", F.col("coef").alias("theta"), "se", bound.alias("bound"),
        (F.col("coef") - bound - F.col("half")).alias("ci_low"), (F.col("coef") + bound + F.col("half")).alias("ci_high"),
        F.greatest((F.abs("coef") - F.col("half")) / F.col("unit"), F.lit(0.0)).alias("breakdown"),
    )
