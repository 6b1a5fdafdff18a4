"""Permutation, bootstrap, spatial errors and multiple testing on the main panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripspark.config import SEED
from tripspark.operators import contrasts, inference
from tripspark.plans.causal import OUTCOMES, long_sql, policy_contrasts
from tripspark.plans.registry import query
from tripspark.plans.space import _POINTS, zone_points

N_PERM = 500
N_BOOT = 9999
_N_WEEKS = "(SELECT count(DISTINCT wk) FROM panel_week)"


def u_sql(*parts: str) -> str:
    text = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"((CAST('0x' || substr(md5(concat_ws('|', {text})), 1, 8) AS BIGINT) + 0.5e0) / 4294967296.0e0)"


_PERM = {
    "pm_c": "SELECT zone, treat, avg(ln_n) FILTER (WHERE post = 1) - avg(ln_n) FILTER (WHERE post = 0) AS c FROM panel_week GROUP BY ALL",
    "pm_rank": f"""SELECT draw, c, row_number() OVER (PARTITION BY draw ORDER BY {u_sql(str(SEED), "draw", "zone")}, zone) AS r
        FROM pm_c CROSS JOIN (SELECT unnest(range(1, {N_PERM + 1})) AS draw) WHERE treat = 0""",
    "pm_draw": """SELECT draw, avg(c) FILTER (WHERE r <= nt) - avg(c) FILTER (WHERE r > nt) AS coef FROM pm_rank
        CROSS JOIN (SELECT count(*) AS nt FROM pm_c WHERE treat = 1) GROUP BY draw""",
    "pm_real": "SELECT avg(c) FILTER (WHERE treat = 1) - avg(c) FILTER (WHERE treat = 0) AS b FROM pm_c",
}


def perm_draws(t):
    c, _ = policy_contrasts(t, t.panel_week, "wk", ["ln_n"])
    treated = t.panel_week.where("treat = 1").select("zone").distinct().count()
    return c, inference.permutation_coefficients(c.where("treat = 0"), "zone", treated, N_PERM, SEED)


@query("permutation_draws", "SELECT CAST(draw AS INTEGER) AS draw, coef FROM pm_draw", "coef", _PERM)
def permutation_draws(t):
    """Coefficients of 500 reassignments among control zones."""
    return perm_draws(t)[1]


@query(
    "permutation_test",
    """SELECT CAST(count(*) AS BIGINT) AS n_perm, (1 + count(*) FILTER (WHERE abs(coef) >= abs(b))) / (1.0e0 + count(*)) AS p_two_sided, avg(coef) AS perm_mean,
         stddev_pop(coef) AS perm_sd, quantile_cont(coef, 0.025) AS perm_p2_5, quantile_cont(coef, 0.975) AS perm_p97_5
       FROM pm_draw CROSS JOIN pm_real""",
    "p_two_sided perm_mean perm_sd perm_p2_5 perm_p97_5",
    _PERM,
)
def permutation_test(t):
    """Two-sided permutation p-value of the policy effect."""
    c, draws = perm_draws(t)
    real = c.agg(F.avg(F.when(F.col("treat") == 1, F.col("c"))) - F.avg(F.when(F.col("treat") == 0, F.col("c")))).scalar()
    return inference.two_sided_p(draws, real)


# residuals of the two-way fit: shared by the variance estimates
_RES = {
    "rs_long": long_sql("panel_week", OUTCOMES, "zone, wk, tp"),
    "rs_dm": """SELECT outcome, zone, wk, y - avg(y) OVER (PARTITION BY outcome, zone) - avg(y) OVER (PARTITION BY outcome, wk) + avg(y) OVER (PARTITION BY outcome) AS y,
        tp - avg(tp) OVER (PARTITION BY outcome, zone) - avg(tp) OVER (PARTITION BY outcome, wk) + avg(tp) OVER (PARTITION BY outcome) AS x FROM rs_long""",
    "rs_fit": "SELECT outcome, sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n, count(DISTINCT zone) AS g, count(DISTINCT wk) AS w FROM rs_dm GROUP BY outcome",
    "rs_adj": "SELECT *, g / (g - 1.0e0) * (n - 1) / greatest(n - 1 - (g + w - 1), 1) AS adj FROM rs_fit",
    "rs_s": "SELECT outcome, zone, wk, x * (y - b * x) AS s FROM rs_dm JOIN rs_fit USING (outcome)",
}


def scored(t, outcomes):
    """Demeaned outcome and treatment in long form, with the fit and its small-sample factor joined."""
    values = F.inline(F.array(*[F.struct(F.lit(y).alias("outcome"), F.col(y).alias("y")) for y in outcomes]))
    long = t.panel_week.select("zone", "wk", F.col("tp").cast("double").alias("x"), values)
    for key in (["outcome", "zone"], ["outcome", "wk"]):
        m = long.groupBy(*key).agg(F.avg("y").alias("_y"), F.avg("x").alias("_x"))
        long = long.join(m, key).withColumns({"y": F.col("y") - F.col("_y"), "x": F.col("x") - F.col("_x")}).drop("_y", "_x")
    fit = long.groupBy("outcome").agg(
        (F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("b"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"),
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("zone").alias("g"),
        F.countDistinct("wk").alias("w"),
    )
    adj = contrasts.clustered_adjustment(F.col("g"), F.col("n"), 1, F.col("g") + F.col("w") - 1)
    fit = fit.withColumn("adj", adj)
    return long, fit


def scores(long, fit):
    return long.join(fit.select("outcome", "b"), "outcome").select("outcome", "zone", "wk", (F.col("x") * (F.col("y") - F.col("b") * F.col("x"))).alias("s"))


@query(
    "twoway_cluster_se",
    """SELECT outcome, b AS coef, sqrt(adj * vz) / sxx AS se_cr1, sqrt(adj * greatest(vz + vw - vc, vz)) / sxx AS se_twoway FROM rs_adj
       JOIN (SELECT outcome, sum(s * s) AS vz FROM (SELECT outcome, zone, sum(s) AS s FROM rs_s GROUP BY ALL) GROUP BY outcome) USING (outcome)
       JOIN (SELECT outcome, sum(s * s) AS vw FROM (SELECT outcome, wk, sum(s) AS s FROM rs_s GROUP BY ALL) GROUP BY outcome) USING (outcome)
       JOIN (SELECT outcome, sum(s * s) AS vc FROM rs_s GROUP BY outcome) USING (outcome)""",
    "coef se_cr1 se_twoway",
    _RES,
)
def twoway_cluster_se(t):
    """Standard errors clustered by zone and by zone and week."""
    long, fit = scored(t, OUTCOMES)
    v = inference.twoway_variance(scores(long, fit), ["outcome"], "zone", "wk").join(fit, "outcome")
    one = F.sqrt(F.col("adj") * F.col("v_unit")) / F.col("sxx")
    return v.select("outcome", F.col("b").alias("coef"), one.alias("se_cr1"), inference.twoway_se(v, "sxx", F.col("adj")).alias("se_twoway"))


_CUTS = (5, 20, 50)
_CON = {
    **_POINTS,
    **_RES,
    "cn_pairs": "SELECT cut, a.zone AS a, b.zone AS b, 1 - sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / cut AS kern FROM zone_xy AS a JOIN zone_xy AS b ON a.zone <> b.zone"
    f" CROSS JOIN (SELECT unnest([{', '.join(f'{c}.0e0' for c in _CUTS)}]) AS cut) WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < cut",
    "cn_sp": "SELECT cut, l.outcome, sum(l.s * kern * r.s) AS spatial FROM cn_pairs JOIN rs_s AS l ON l.zone = a JOIN rs_s AS r ON r.zone = b AND r.outcome = l.outcome AND r.wk = l.wk GROUP BY ALL",
    "cn_vz": "SELECT outcome, sum(s * s) AS vz FROM (SELECT outcome, zone, sum(s) AS s FROM rs_s GROUP BY ALL) GROUP BY outcome",
    "cn_grid": f"SELECT outcome, cut FROM rs_fit CROSS JOIN (SELECT unnest([{', '.join(f'{c}.0e0' for c in _CUTS)}]) AS cut)",
}


@query(
    "conley_se",
    """SELECT outcome, cut, b AS coef, sqrt(greatest(adj * (vz + coalesce(spatial, 0)), 0)) / sxx AS se_conley FROM cn_grid JOIN rs_adj USING (outcome) JOIN cn_vz USING (outcome)
       LEFT JOIN cn_sp USING (outcome, cut)""",
    "coef se_conley",
    _CON,
)
def conley_se(t):
    """Spatial standard errors with a Bartlett kernel for three cut-offs."""
    long, fit = scored(t, OUTCOMES)
    s = scores(long, fit)
    pts = zone_points(t).select(F.col("zone").cast("int").alias("zone"), "x", "y")
    vz = s.groupBy("outcome", "zone").agg(F.sum("s").alias("s")).groupBy("outcome").agg(F.sum(F.col("s") * F.col("s")).alias("vz"))
    base, out = fit.join(vz, "outcome"), None
    for cut in _CUTS:
        sp = inference.conley_spatial(s, pts, ["outcome"], "zone", "wk", float(cut))
        v = F.greatest(F.col("adj") * (F.col("vz") + F.coalesce("spatial", F.lit(0.0))), F.lit(0.0))
        one = base.join(sp, "outcome", "left").select("outcome", F.lit(float(cut)).alias("cut"), F.col("b").alias("coef"), (F.sqrt(v) / F.col("sxx")).alias("se_conley"))
        out = one if out is None else out.unionByName(one)
    return out


_WEBB = "CASE CAST(floor(u * 6) AS INTEGER) WHEN 0 THEN -sqrt(1.5e0) WHEN 1 THEN -1.0e0 WHEN 2 THEN -sqrt(0.5e0) WHEN 3 THEN sqrt(0.5e0) WHEN 4 THEN 1.0e0 ELSE sqrt(1.5e0) END"
_WILD = {
    **_RES,
    "wb_parts": "SELECT outcome, zone, sum(x * y) AS a, sum(x * x) AS q, sum(x * y) - any_value(b) * sum(x * x) AS e FROM rs_dm JOIN rs_fit USING (outcome) GROUP BY outcome, zone",
    "wb_v": f"SELECT draw, zone, {_WEBB} AS v FROM (SELECT draw, zone, {u_sql(str(SEED), 'draw', 'zone')} AS u FROM (SELECT DISTINCT zone FROM panel_week) CROSS JOIN (SELECT unnest(range(1, {N_BOOT + 1})) AS draw))",
    "wb_beta": "SELECT outcome, draw, sum(v * a) / sum(q) AS b0, sum(v * e) / sum(q) AS b1, sum(q) AS sxx FROM wb_parts JOIN wb_v USING (zone) GROUP BY ALL",
    "wb_t": """SELECT outcome, draw, any_value(b0) * any_value(wb_beta.sxx) / sqrt(any_value(adj) * sum(pow(v * a - b0 * q, 2))) AS t_null,
        any_value(b1) * any_value(wb_beta.sxx) / sqrt(any_value(adj) * sum(pow(v * e - b1 * q, 2))) AS t_centred
        FROM wb_parts JOIN wb_v USING (zone) JOIN wb_beta USING (outcome, draw) JOIN rs_adj USING (outcome) GROUP BY outcome, draw""",
    "wb_obs": "SELECT outcome, b AS coef, sqrt(adj * vz) / sxx AS se, b * sxx / sqrt(adj * vz) AS t FROM rs_adj JOIN (SELECT outcome, sum(e * e) AS vz FROM wb_parts GROUP BY outcome) USING (outcome)",
    "wb_p": f"SELECT outcome, greatest(avg(CASE WHEN abs(t_null) >= abs(t) THEN 1.0e0 ELSE 0.0e0 END), 1.0e0 / ({N_BOOT} + 1)) AS p FROM wb_t JOIN wb_obs USING (outcome) GROUP BY outcome",
}


def bootstrap(t):
    long, fit = scored(t, OUTCOMES)
    parts = inference.cluster_parts(long, ["outcome"], "zone").join(fit.select("outcome", "b", "adj", "sxx"), "outcome")
    boot = inference.wild_bootstrap(parts, ["outcome", "adj"], N_BOOT, SEED, F.col("adj")).drop("adj")
    u = F.col("a") - F.col("b") * F.col("q")
    observed = parts.groupBy("outcome", F.col("b").alias("coef"), "adj", "sxx").agg(F.sum(u * u).alias("v"))
    se = F.sqrt(F.col("adj") * F.col("v")) / F.col("sxx")
    observed = observed.select("outcome", "coef", se.alias("se"), F.try_divide(F.col("coef"), se).alias("t"))
    return boot, observed


@query(
    "wild_bootstrap",
    f"""SELECT outcome, coef, se, greatest(avg(CASE WHEN abs(t_null) >= abs(t) THEN 1.0e0 ELSE 0.0e0 END), 1.0e0 / ({N_BOOT} + 1)) AS p_wild,
          coef - quantile_cont(t_centred, 0.975) * se AS ci_low, coef - quantile_cont(t_centred, 0.025) * se AS ci_high
        FROM wb_t JOIN wb_obs USING (outcome) GROUP BY outcome, coef, se, t""",
    "coef se p_wild ci_low ci_high",
    _WILD,
)
def wild_bootstrap(t):
    """Wild cluster bootstrap p-values and intervals, all draws in one aggregate."""
    boot, observed = bootstrap(t)
    return inference.wild_summary(boot, observed, ["outcome"])


@query(
    "romano_wolf",
    f"""SELECT outcome, CAST(step AS INTEGER) AS step, greatest(max(p) OVER (ORDER BY step), 1.0e0 / ({N_BOOT} + 1)) AS romano_wolf FROM (
          SELECT r.outcome, r.step, avg(CASE WHEN m.t_max >= r.ta THEN 1.0e0 ELSE 0.0e0 END) AS p
          FROM (SELECT outcome, abs(t) AS ta, row_number() OVER (ORDER BY abs(t) DESC, outcome) AS step FROM wb_obs) AS r
          JOIN (SELECT s.step, w.draw, max(abs(w.t_centred)) AS t_max
                FROM (SELECT outcome, row_number() OVER (ORDER BY abs(t) DESC, outcome) AS step FROM wb_obs) AS s
                JOIN (SELECT outcome, row_number() OVER (ORDER BY abs(t) DESC, outcome) AS st FROM wb_obs) AS o ON o.st >= s.step
                JOIN wb_t AS w ON w.outcome = o.outcome GROUP BY s.step, w.draw) AS m USING (step) GROUP BY r.outcome, r.step)""",
    "romano_wolf",
    _WILD,
)
def romano_wolf(t):
    """Step-down p-values over the outcomes, from joint draws."""
    boot, observed = bootstrap(t)
    return inference.romano_wolf(boot, observed)


@query(
    "holm_bh_adjust",
    """SELECT outcome, p, least(max((m - i + 1) * p) OVER (ORDER BY i), 1) AS p_holm, least(min(p * m / i) OVER (ORDER BY i DESC), 1) AS q_bh
       FROM (SELECT outcome, p, row_number() OVER (ORDER BY p, outcome) AS i, count(*) OVER () AS m FROM wb_p)""",
    "p p_holm q_bh",
    _WILD,
)
def holm_bh_adjust(t):
    """Holm and Benjamini-Hochberg adjustment of the bootstrap p-values."""
    boot, observed = bootstrap(t)
    p = inference.wild_summary(boot, observed, ["outcome"]).select("outcome", F.col("p_wild").alias("p"))
    return inference.holm_bh(p, "p", ["outcome"])


