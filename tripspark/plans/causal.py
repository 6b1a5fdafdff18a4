"""Panels, difference-in-differences, event studies and their tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tripspark.functions.exprs import flag, ratio, safe_ln
from tripspark.operators import clean, contrasts, fe_batch, fixed_effects
from tripspark.operators import panel as panels
from tripspark.operators.panel import RATIOS
from tripspark.plans.registry import query
from tripspark.plans.standin import MIN_DAILY, SUM_ROUND

OUTCOMES = ["ln_n", "fare_pm", "rider_pt", "mph", "miles_pt"]
MAIN = ["ln_n", "mph"]


def difference_sql(source: str, by: str, periods: str, k: str = "1", extra: str = "0", prefix: str = "df") -> tuple[dict[str, str], str]:
    """SQL of a difference in mean contrasts with clustered errors.

    ``source`` has by-columns, treat, cluster, w and c; ``periods``, ``k`` and ``extra`` are SQL expressions.
    """
    cols = ", ".join(by.split())
    ctes = {
        f"{prefix}_m": f"SELECT {cols}, treat, sum(w * c) / sum(w) AS m, sum(w) AS wt, count(*) AS nu FROM {source} GROUP BY {cols}, treat",
        f"{prefix}_s": f"""SELECT {cols}, cluster, sum(CASE WHEN treat = 1 THEN 1 ELSE -1 END * w * (c - m) / wt) AS s
            FROM {source} JOIN {prefix}_m USING ({cols}, treat) GROUP BY {cols}, cluster""",
        f"{prefix}_v": f"SELECT {cols}, sum(s * s) AS v, count(*) AS g FROM {prefix}_s GROUP BY {cols}",
        f"{prefix}_c": f"SELECT {cols}, sum(CASE WHEN treat = 1 THEN m ELSE -m END) AS coef, sum(nu) AS nu FROM {prefix}_m GROUP BY {cols} HAVING count(*) = 2",
    }
    final = f"""SELECT {cols}, coef, sqrt(adj * v) AS se, coef / nullif(sqrt(adj * v), 0) AS t, CAST(nobs AS BIGINT) AS n_obs, CAST(g AS BIGINT) AS n_clusters FROM (
        SELECT *, nu * {periods} AS nobs, g / (g - 1.0e0) * (nu * {periods} - 1) / greatest(nu * {periods} - {k} - (nu + {periods} - 1 + {extra}), 1) AS adj
        FROM {prefix}_c JOIN {prefix}_v USING ({cols}))"""
    return ctes, final


def long_sql(panel: str, outcomes: list[str], keep: str) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{y}' AS outcome, CAST({y} AS DOUBLE) AS y FROM {panel}" for y in outcomes)


def policy_contrasts(t, panel, period, outcomes, spec="twfe", unit="zone", keep=("treat",), extra_cols=()):
    periods = contrasts.periods_of(panel, [period, "post", *extra_cols])
    weights = contrasts.weights_frame(t.spark, period, panel.schema[period].dataType, contrasts.post_weights(periods, spec))
    return contrasts.unit_contrasts(panel, unit, period, outcomes, weights, list(keep), len(periods)), len(periods)


# ------------------------------------------------------------------ panels
_PW = "zone, wk, grp, CAST(n AS BIGINT) AS n, fare, miles, treat, post, tp, k, km, woy, w_pre, month, ln_n, mph, rider_pt"


@query("did_panel", f"SELECT {_PW} FROM panel_week", SUM_ROUND.split()[0] + " miles:4 w_pre ln_n mph rider_pt")
def did_panel(t):
    """Balanced zone × week panel with treatment and relative time."""
    names = "zone wk grp n fare miles treat post tp k km woy w_pre month ln_n mph rider_pt".split()
    return t.panel_week.select(*names)


@query("panel_day", "SELECT zone, d, grp, CAST(n AS BIGINT) AS n, treat, post, tp, weekend, w_pre, ln_n, mph FROM panel_day", "w_pre ln_n mph")
def panel_day(t):
    """Zone × day panel of large zones."""
    return t.panel_day.select("zone", "d", "grp", "n", "treat", "post", "tp", "weekend", "w_pre", "ln_n", "mph")


@query("panel_od_month", "SELECT pair, pu, dl, period, ftype, CAST(n AS BIGINT) AS n, treat, post, tp, w_pre, ln_n, mph, rider_pt FROM panel_od", "w_pre ln_n mph rider_pt")
def panel_od_month(t):
    """Balanced origin-destination panel."""
    return t.panel_od.select("pair", "pu", "dl", "period", "ftype", "n", "treat", "post", "tp", "w_pre", "ln_n", "mph", "rider_pt")


@query("panel_hour", "SELECT zone, period, hbin, grp, CAST(n AS BIGINT) AS n, treat, post, tp, w_pre, ln_n, mph FROM panel_hour", "w_pre ln_n mph")
def panel_hour(t):
    """Zone × hour bin panel."""
    return t.panel_hour.select("zone", "period", "hbin", "grp", "n", "treat", "post", "tp", "w_pre", "ln_n", "mph")


@query("panel_long", "SELECT zone, ym, grp, CAST(n AS BIGINT) AS n, treat, post, year, moy, w_pre, ln_n, mph, rider_ex_pt FROM panel_long", "w_pre ln_n mph rider_ex_pt")
def panel_long(t):
    """Balanced zone × month panel over 48 months."""
    return t.panel_long.select("zone", "ym", "grp", "n", "treat", "post", "year", "moy", "w_pre", "ln_n", "mph", "rider_ex_pt")


@query(
    "balanced_panel",
    "SELECT zone, w_pre FROM panel_week_keep",
    "w_pre",
)
def balanced_panel(t):
    """Zones present in every week and above the volume floor."""
    return t.panel_week.select("zone", "w_pre").distinct()


@query("semi_filter", "SELECT DISTINCT pu, dl FROM od_month WHERE pu IN (SELECT zone FROM panel_week_keep) AND dl IN (SELECT zone FROM panel_week_keep)")
def semi_filter(t):
    """Pairs whose two zones are both in the panel."""
    keep = t.panel_week.select("zone").distinct()
    od = t.gold("od_month").select("pu", "dl").distinct()
    return od.join(keep.withColumnRenamed("zone", "pu"), "pu", "left_semi").join(keep.withColumnRenamed("zone", "dl"), "dl", "left_semi").select("pu", "dl")


@query(
    "same_window_yoy",
    "SELECT grp, sum(n) FILTER (WHERE year(d) = 2024) AS y2024, sum(n) FILTER (WHERE year(d) = 2025) AS y2025,"
    " 100.0e0 * (CAST(sum(n) FILTER (WHERE year(d) = 2025) AS DOUBLE) / sum(n) FILTER (WHERE year(d) = 2024) - 1) AS yoy_pct"
    " FROM zone_day_pu JOIN dim_zone USING (zone) WHERE (d BETWEEN DATE '2024-01-05' AND DATE '2024-12-31' OR d BETWEEN DATE '2025-01-05' AND DATE '2025-12-31') GROUP BY grp",
    "y2024:4 y2025:4 yoy_pct",
)
def same_window_yoy(t):
    """Change between the same calendar days of both years."""
    from tripspark.operators.timeops import year_over_year

    z = t.gold("zone_day_pu").where(clean.same_window()).withColumn("yr", F.year("d")).join(t.dim_zone.select("zone", "grp"), "zone")
    return year_over_year(z, ["grp"], "n")


# ------------------------------------------------------------------ demeaning
@query(
    "fe_demean_twoway",
    """SELECT zone, wk, ln_n - avg(ln_n) OVER (PARTITION BY zone) - avg(ln_n) OVER (PARTITION BY wk) + avg(ln_n) OVER () AS ln_n,
         mph - avg(mph) OVER (PARTITION BY zone) - avg(mph) OVER (PARTITION BY wk) + avg(mph) OVER () AS mph FROM panel_week""",
    "ln_n mph",
)
def fe_demean_twoway(t):
    """Two-way within transform, solved exactly."""
    return fixed_effects.demean(t.panel_week.select("zone", "wk", "ln_n", "mph"), ["ln_n", "mph"], ["zone", "wk"]).select("zone", "wk", "ln_n", "mph")


@query(
    "fe_demean_weighted",
    """SELECT zone, wk, ln_n - avg(ln_n) OVER (PARTITION BY zone) - sum(w_pre * ln_n) OVER (PARTITION BY wk) / sum(w_pre) OVER (PARTITION BY wk)
         + sum(w_pre * ln_n) OVER () / sum(w_pre) OVER () AS ln_n FROM panel_week""",
    "ln_n",
)
def fe_demean_weighted(t):
    """Two-way within transform with unit weights, in one pass."""
    cells = t.panel_week.select("zone", "wk", "ln_n", "w_pre")
    return fixed_effects.within_twoway_balanced(cells, ["ln_n"], "zone", "wk", "w_pre").select("zone", "wk", "ln_n")


# ------------------------------------------------------------------ main estimates
_N_WEEKS = "(SELECT count(DISTINCT wk) FROM panel_week)"
_TWFE = {
    "pw_long": long_sql("panel_week", OUTCOMES, "zone, wk, treat, post, k, woy, w_pre"),
    "twfe_c": "SELECT zone AS cluster, treat, outcome, 1.0e0 AS w, avg(y) FILTER (WHERE post = 1) - avg(y) FILTER (WHERE post = 0) AS c FROM pw_long GROUP BY ALL",
}
_twfe_ctes, _twfe_final = difference_sql("twfe_c", "outcome", _N_WEEKS)


@query("did_twfe", _twfe_final, "coef se t:4", {**_TWFE, **_twfe_ctes})
def did_twfe(t):
    """Two-way fixed-effects estimate of the policy effect with clustered errors."""
    c, n = policy_contrasts(t, t.panel_week, "wk", OUTCOMES)
    return contrasts.estimate(c, ["outcome"], n)


# every outcome; units without a value in some week are left out of that outcome, as in the operator
_ALL_LONG = long_sql("panel_week", list(RATIOS), "zone, wk, treat, post, k, woy, w_pre")
_SPECS = {
    **_TWFE,
    "pw_any": _ALL_LONG,
    "pw_long": f"SELECT * FROM pw_any SEMI JOIN (SELECT zone, outcome FROM pw_any GROUP BY ALL HAVING count(y) = {_N_WEEKS}) USING (zone, outcome)",
    "pw_wk": "SELECT DISTINCT wk, post, k, woy FROM panel_week",
    # effect of post next to a linear trend: residual of post on k, over the calendar
    "pw_trend": """SELECT wk, r / sum(r * r) OVER () AS a FROM (SELECT wk, post - (SELECT regr_intercept(post, k) FROM pw_wk) - (SELECT regr_slope(post, k) FROM pw_wk) * k AS r FROM pw_wk)""",
    # effect of post inside position weeks
    "pw_season": """SELECT wk, r / sum(r * r) OVER () AS a FROM (SELECT wk, post - avg(post) OVER (PARTITION BY woy) AS r FROM pw_wk)""",
    "spec_c": """SELECT 'twfe' AS spec, cluster, treat, outcome, w, c FROM twfe_c
        UNION ALL SELECT 'weighted', zone, treat, outcome, any_value(w_pre), avg(y) FILTER (WHERE post = 1) - avg(y) FILTER (WHERE post = 0) FROM pw_long GROUP BY zone, treat, outcome
        UNION ALL SELECT 'trend', zone, treat, outcome, 1.0e0, sum(a * y) FROM pw_long JOIN pw_trend USING (wk) GROUP BY zone, treat, outcome
        UNION ALL SELECT 'seasonal', zone, treat, outcome, 1.0e0, sum(a * y) FROM pw_long JOIN pw_season USING (wk) GROUP BY zone, treat, outcome""",
}
_spec_ctes, _spec_final = difference_sql(
    "spec_c", "spec outcome", _N_WEEKS, "CASE WHEN spec = 'trend' THEN 2 ELSE 1 END",
    "CASE WHEN spec = 'seasonal' THEN (SELECT 2 * count(DISTINCT woy) - 1 FROM panel_week) ELSE 0 END",
)


@query("did_specs", _spec_final, "coef se t:4", {**_SPECS, **_spec_ctes})
def did_specs(t):
    """Plain, weighted, group-trend and seasonal specifications of every outcome."""
    panel = t.panel_week
    out = None
    for spec in ("twfe", "weighted", "trend", "seasonal"):
        kind = "twfe" if spec == "weighted" else spec
        c, n = policy_contrasts(t, panel, "wk", RATIOS, kind, keep=("treat", "w_pre"), extra_cols=("k", "woy"))
        levels = 2 * len(contrasts.periods_of(panel, ["woy"])) - 1 if spec == "seasonal" else 0
        one = contrasts.estimate(
            c, ["outcome"], n, k=2 if spec == "trend" else 1, extra_levels=levels, weight="w_pre" if spec == "weighted" else None
        ).withColumn("spec", F.lit(spec))
        out = one if out is None else out.unionByName(one)
    return out


# the same four specifications for each service, every outcome, with gaps: alternating projections, then partial regression
_GAP_CTES = {
    "gap_long": long_sql("panel_service", list(RATIOS), "service, zone, wk, treat, post, tp, k, woy, w_pre"),
    "gap_rows": """SELECT service, outcome, spec, zone, wk, CASE WHEN spec = 'seasonal' THEN treat * 100 + woy ELSE 0 END AS tw,
        CASE WHEN spec = 'weighted' THEN w_pre ELSE 1.0e0 END AS w, y, CAST(tp AS DOUBLE) AS tp,
        CASE WHEN spec = 'trend' THEN treat * k / 52.0e0 ELSE 0.0e0 END AS tr
        FROM gap_long CROSS JOIN (VALUES ('twfe'), ('weighted'), ('trend'), ('seasonal')) AS s(spec) WHERE y IS NOT NULL""",
}


def _projection(by: str, columns: list[str], keys: list[str], source: str, keep: str = "") -> str:
    """Subtract weighted means by each key, one after the other."""
    out = source
    for key in keys:
        window = f"OVER (PARTITION BY {by}, {key})"
        parts = ", ".join(f"{c} - sum(w * {c}) {window} / sum(w) {window} AS {c}" for c in columns)
        out = f"(SELECT i, {by}, {', '.join(keys)}, {keep}w, {parts} FROM {out})"
    return out


_GAP_SQL = f"""SELECT service, outcome, spec, 'tp' AS term, coef, sqrt(adj * meat) / stt AS se, CAST(n AS BIGINT) AS n_obs, CAST(g AS BIGINT) AS n_clusters FROM (
  WITH RECURSIVE gap_p AS (SELECT 0 AS i, * FROM gap_rows UNION ALL
    SELECT i + 1 AS i, service, outcome, spec, zone, wk, tw, w, y, tp, tr FROM {_projection("service, outcome, spec", ["y", "tp", "tr"], ["zone", "wk", "tw"], "gap_p")} WHERE i < 24),
  gap_done AS (SELECT * FROM gap_p WHERE i = 24),
  gap_tr AS (SELECT service, outcome, spec, coalesce(sum(w * tp * tr) / nullif(sum(w * tr * tr), 0), 0) AS c FROM gap_done GROUP BY ALL),
  gap_t AS (SELECT *, tp - c * tr AS tt FROM gap_done JOIN gap_tr USING (service, outcome, spec)),
  gap_y AS (SELECT service, outcome, spec, coalesce(sum(w * y * tr) / nullif(sum(w * tr * tr), 0), 0) AS cy FROM gap_done GROUP BY ALL),
  gap_b AS (SELECT service, outcome, spec, sum(w * tt * y) / sum(w * tt * tt) AS coef, sum(w * tt * tt) AS stt FROM gap_t GROUP BY ALL),
  gap_s AS (SELECT service, outcome, spec, zone, sum(w * tt * (y - cy * tr - coef * tt)) AS s
            FROM gap_t JOIN gap_y USING (service, outcome, spec) JOIN gap_b USING (service, outcome, spec) GROUP BY ALL),
  gap_m AS (SELECT service, outcome, spec, sum(s * s) AS meat, count(*) AS g FROM gap_s GROUP BY ALL),
  gap_n AS (SELECT service, outcome, spec, count(*) AS n, count(DISTINCT zone) + count(DISTINCT wk) - 1
            + CASE WHEN spec = 'seasonal' THEN count(DISTINCT tw) - 1 ELSE 0 END AS levels FROM gap_done GROUP BY service, outcome, spec)
  SELECT *, g / (g - 1.0e0) * (n - 1) / greatest(n - CASE WHEN spec = 'trend' THEN 2 ELSE 1 END - levels, 1) AS adj
  FROM gap_b JOIN gap_m USING (service, outcome, spec) JOIN gap_n USING (service, outcome, spec))
WHERE stt > 1e-9"""

SPECS = (
    fe_batch.Spec("twfe", ("tp",), ("zone", "wk"), "zone"),
    fe_batch.Spec("weighted", ("tp",), ("zone", "wk"), "zone", "w_pre"),
    fe_batch.Spec("trend", ("tp", "trend"), ("zone", "wk"), "zone"),
    fe_batch.Spec("seasonal", ("tp",), ("zone", "wk", "tw"), "zone"),
)


@query("did_services", _GAP_SQL, "coef se:5", _GAP_CTES)
def did_services(t):
    """Four specifications of every outcome for each service; zones with gaps stay in, missing values drop out singly."""
    rows = t.panel_service.withColumns({"trend": F.col("treat") * F.col("k") / 52.0, "tw": F.concat_ws("_", "treat", "woy")})
    fits = fe_batch.fe_ols_batch(rows, RATIOS, SPECS, by=("service",))
    return fits.where("term = 'tp' AND coef IS NOT NULL").select("service", "outcome", "spec", "term", "coef", "se", "n_obs", "n_clusters")


@query("fe_ols_multi")
def fe_ols_multi(t):
    """General regression: seasonal effects, a group trend, and a day panel with holes."""
    week = t.panel_week.withColumns({"trend": F.col("treat") * F.col("k") / 52.0, "tw": F.concat_ws("_", "treat", "woy")})
    day = t.panel_day.withColumn("tp_we", F.col("tp") * F.col("weekend"))
    out = fe_batch.fe_ols_batch(week, ["ln_n"], SPECS)
    daily = fe_batch.fe_ols_batch(day, ["ln_n"], [fe_batch.Spec("weekend", ("tp", "tp_we"), ("d", "zone"), "zone")])
    return out.unionByName(daily).withColumnRenamed("spec", "model").drop("outcome")


@query("fe_ols_balanced", f"SELECT spec AS model, coef, se, n_obs, n_clusters FROM ({_spec_final}) WHERE outcome = 'ln_n'", "coef se", {**_SPECS, **_spec_ctes})
def fe_ols_balanced(t):
    """The policy effect by the general solver, checked against the closed forms of a balanced panel."""
    return fe_ols_multi(t).where("term = 'tp' AND model <> 'weekend'").select("model", "coef", "se", "n_obs", "n_clusters")


@query("did_inference")
def did_inference(t):
    """The main estimates with p-values and confidence intervals."""
    c, n = policy_contrasts(t, t.panel_week, "wk", OUTCOMES)
    return contrasts.with_p_values(contrasts.estimate(c, ["outcome"], n))


# ------------------------------------------------------------------ event studies
def event_contrasts(t, panel, period, rel, outcomes, centred, unit="zone", keep=("treat",), ref=-1):
    periods = contrasts.periods_of(panel, [period, rel])
    weights = contrasts.weights_frame(t.spark, period, panel.schema[period].dataType, contrasts.event_weights(periods, ref, centred))
    return contrasts.unit_contrasts(panel, unit, period, outcomes, weights, list(keep), len(periods)), len(periods)


_EV = {
    "ev_long": "SELECT zone, treat, k, ln_n AS y FROM panel_week",
    "ev_ref": "SELECT zone, sum(y) FILTER (WHERE k = -1) AS y_ref, avg(y) FILTER (WHERE k < 0) AS y_pre FROM ev_long GROUP BY zone",
    "ev_c": "SELECT k, zone AS cluster, treat, 1.0e0 AS w, y - y_ref AS c FROM ev_long JOIN ev_ref USING (zone) WHERE k <> -1",
    "ev_cc": "SELECT k, zone AS cluster, treat, 1.0e0 AS w, y - y_pre AS c FROM ev_long JOIN ev_ref USING (zone) WHERE k <> -1",
}
_ev_k = f"({_N_WEEKS} - 1)"
_ev1, _evf1 = difference_sql("ev_c", "k", _N_WEEKS, _ev_k, prefix="e1")
_ev2, _evf2 = difference_sql("ev_cc", "k", _N_WEEKS, _ev_k, prefix="e2")


def event_table(t, panel, period, rel, outcomes, unit="zone", cluster="zone", keep=("treat",)):
    """Coefficients relative to the last pre-period and to the pre-period mean, side by side."""
    raw, n = event_contrasts(t, panel, period, rel, outcomes, False, unit, keep)
    mid, _ = event_contrasts(t, panel, period, rel, outcomes, True, unit, keep)
    by = ["outcome", "term"]
    a = contrasts.estimate(raw, by, n, k=n - 1, cluster=cluster)
    b = contrasts.estimate(mid, by, n, k=n - 1, cluster=cluster)
    return a.join(b.select(*by, F.col("coef").alias("coef_c"), F.col("se").alias("se_c")), by)


@query(
    "event_study",
    f"SELECT a.k, a.coef, a.se, b.coef AS coef_c, b.se AS se_c, a.n_obs, a.n_clusters FROM ({_evf1}) AS a JOIN ({_evf2}) AS b ON a.k = b.k",
    "coef se coef_c se_c",
    {**_EV, **_ev1, **_ev2},
)
def event_study(t):
    """Weekly dynamic effects on log trips, raw and centred on the pre-period mean."""
    out = event_table(t, t.panel_week, "wk", "k", ["ln_n"])
    return out.select(F.col("term").cast("int").alias("k"), "coef", "se", "coef_c", "se_c", "n_obs", "n_clusters")


def wald_rows(t, panel, period, rel, outcomes, unit="zone", cluster="zone", keep=("treat",)):
    """Joint tests that all centred pre-period effects are zero; the matrices are period-sized."""
    rows = []
    c, n = event_contrasts(t, panel, period, rel, outcomes, True, unit, keep)
    c = c.where(F.col("term").cast("int") < 0)
    est = {(r["outcome"], r["term"]): r["coef"] for r in contrasts.estimate(c, ["outcome", "term"], n, k=n - 1, cluster=cluster).collect()}
    cov = contrasts.covariance(c, "outcome", n, k=n - 1, cluster=cluster).collect()
    for y in outcomes:
        terms = sorted({a for o, a in est if o == y}, key=int)
        at = {a: i for i, a in enumerate(terms)}
        v = np.zeros((len(terms), len(terms)))
        for r in cov:
            if r["outcome"] == y:
                v[at[r["a"]], at[r["b"]]] = r["v"]
        stat, rank, p = contrasts.wald(np.array([est[y, a] for a in terms]), v)
        rows.append((y, stat, rank, p))
    return t.spark.createDataFrame(rows, "outcome string, wald double, dof int, p double")


@query("event_wald")
def event_wald(t):
    """Pre-trend tests of the weekly event study."""
    return wald_rows(t, t.panel_week, "wk", "k", ["ln_n"])




_DDD = {
    "ddd_base": "SELECT zone, woy, avg(ln_n) AS y0 FROM panel_week WHERE post = 0 GROUP BY ALL",
    "ddd_c": "SELECT k, zone AS cluster, treat, 1.0e0 AS w, ln_n - y0 AS c FROM panel_week JOIN ddd_base USING (zone, woy) WHERE post = 1",
}
_ddd_ctes, _ddd_final = difference_sql(
    "ddd_c", "k", _N_WEEKS, "(SELECT count(DISTINCT k) FROM panel_week WHERE post = 1)", "(SELECT 2 * count(DISTINCT woy) - 1 FROM panel_week)"
)


@query("event_ddd", _ddd_final, "coef se t:4", {**_DDD, **_ddd_ctes})
def event_ddd(t):
    """Weekly effects after the policy against the same position week before it."""
    panel = t.panel_week
    periods = contrasts.periods_of(panel, ["wk", "post", "k", "woy"])
    before = {}
    for wk, post, _, woy in periods:
        if not post:
            before.setdefault(woy, []).append(wk)
    terms = {
        str(k): {wk: 1.0, **{w: -1.0 / len(before[woy]) for w in before[woy]}} for wk, post, k, woy in periods if post and woy in before
    }
    weights = contrasts.weights_frame(t.spark, "wk", panel.schema["wk"].dataType, terms)
    c = contrasts.unit_contrasts(panel, "zone", "wk", ["ln_n"], weights, ["treat"], len(periods))
    levels = 2 * len({p[3] for p in periods}) - 1
    out = contrasts.estimate(c, ["term"], len(periods), k=len(terms), extra_levels=levels)
    return out.select(F.col("term").cast("int").alias("k"), "coef", "se", "t", "n_obs", "n_clusters")


_EM = {
    "em_long": long_sql("panel_week", ["fare_pm", "rider_pt", "mph"], "zone, treat, km"),
    "em_unit": """SELECT outcome, zone, treat, km, avg(y) AS y FROM em_long GROUP BY ALL""",
    "em_pre": "SELECT outcome, zone, avg(y) AS y_pre, max(y) FILTER (WHERE km = -1) AS y_ref FROM em_unit WHERE km < 0 GROUP BY ALL",
    "em_c": "SELECT outcome, km, zone AS cluster, treat, 1.0e0 AS w, y - y_ref AS c FROM em_unit JOIN em_pre USING (outcome, zone) WHERE km <> -1",
    "em_jump": """SELECT outcome, treat, avg(j) AS j FROM (SELECT outcome, zone, treat, avg(y) FILTER (WHERE km BETWEEN 0 AND 2) - avg(y) FILTER (WHERE km BETWEEN -3 AND -1) AS j
        FROM em_unit GROUP BY ALL) GROUP BY ALL""",
}
_em_ctes, _em_final = difference_sql("em_c", "outcome km", _N_WEEKS, "(SELECT count(DISTINCT km) - 1 FROM panel_week)")


@query(
    "event_monthly",
    f"""SELECT e.*, j.jump_3v3 FROM ({_em_final}) AS e JOIN (SELECT outcome, max(j) FILTER (WHERE treat = 1) - max(j) FILTER (WHERE treat = 0) AS jump_3v3
        FROM em_jump GROUP BY outcome) AS j USING (outcome)""",
    "coef se t:4 jump_3v3",
    {**_EM, **_em_ctes},
)
def event_monthly(t):
    """Monthly effects on a weekly panel and the jump between three months before and after."""
    panel = t.panel_week
    periods = contrasts.periods_of(panel, ["wk", "km"])
    weeks: dict[int, list] = {}
    for wk, km in periods:
        weeks.setdefault(km, []).append(wk)

    def mean_of(km, sign=1.0):
        return {wk: sign / len(weeks[km]) for wk in weeks.get(km, [])}

    terms = {str(km): {**mean_of(km), **mean_of(-1, -1.0)} for km in weeks if km != -1}
    jump: dict = {}
    for km, sign in [(0, 1), (1, 1), (2, 1), (-1, -1), (-2, -1), (-3, -1)]:
        for wk, a in mean_of(km, sign / 3.0).items():
            jump[wk] = jump.get(wk, 0.0) + a
    outcomes = ["fare_pm", "rider_pt", "mph"]
    weights = contrasts.weights_frame(t.spark, "wk", panel.schema["wk"].dataType, {**terms, "jump": jump})
    c = contrasts.unit_contrasts(panel, "zone", "wk", outcomes, weights, ["treat"], len(periods))
    est = contrasts.estimate(c, ["outcome", "term"], len(periods), k=len(terms))
    months = est.where("term <> 'jump'").withColumn("km", F.col("term").cast("int")).drop("term")
    return months.join(est.where("term = 'jump'").select("outcome", F.col("coef").alias("jump_3v3")), "outcome")


# ------------------------------------------------------------------ heterogeneity
_N_Q = "(SELECT count(DISTINCT period) FROM panel_hour)"
_HR = {
    "hr_long": long_sql("panel_hour", MAIN, "hbin, zone, period, treat, post"),
    "hr_c": f"""SELECT hbin, outcome, zone AS cluster, treat, 1.0e0 AS w, avg(y) FILTER (WHERE post = 1) - avg(y) FILTER (WHERE post = 0) AS c FROM hr_long
        GROUP BY ALL HAVING count(y) = {_N_Q}""",
}
_hr_ctes, _hr_final = difference_sql("hr_c", "hbin outcome", _N_Q)


@query("did_by_hour", _hr_final, "coef se t:4", {**_HR, **_hr_ctes})
def did_by_hour(t):
    """The policy effect per hour bin, all bins in one job."""
    panel = t.panel_hour.withColumn("unit", F.concat_ws("_", "zone", "hbin"))
    c, n = policy_contrasts(t, panel, "period", MAIN, unit="unit", keep=("treat", "zone", "hbin"))
    return contrasts.estimate(c, ["hbin", "outcome"], n)


_OD_OUT = ["ln_n", "rider_pt", "cbd_pt", "fare_pt", "mph"]
_N_OQ = "(SELECT count(DISTINCT period) FROM panel_od)"
_OD = {
    "od_long": long_sql("panel_od", _OD_OUT, "pair, pu, period, ftype, treat, post"),
    "od_c1": f"""SELECT outcome, pair, pu AS cluster, ftype, treat, 1.0e0 AS w, avg(y) FILTER (WHERE post = 1) - avg(y) FILTER (WHERE post = 0) AS c,
        avg(y) FILTER (WHERE post = 0) AS y_pre FROM od_long GROUP BY ALL HAVING count(y) = {_N_OQ}""",
    "od_flow": "SELECT unnest(['all', 'inside', 'outbound', 'inbound']) AS flow",
    "od_c": "SELECT flow, outcome, cluster, treat, w, c, y_pre FROM od_c1 CROSS JOIN od_flow WHERE treat = 0 OR flow = 'all' OR flow = ftype",
}
_od_ctes, _od_final = difference_sql("od_c", "flow outcome", _N_OQ)


def od_effects(t):
    """Effects per flow type; each subset keeps all untouched pairs as controls."""
    c, n = policy_contrasts(t, t.panel_od, "period", _OD_OUT, unit="pair", keep=("treat", "pu", "ftype"))
    flows = F.when(F.col("treat") == 0, F.array(*map(F.lit, ("all", "inside", "outbound", "inbound")))).otherwise(F.array(F.lit("all"), F.col("ftype")))
    return contrasts.estimate(c.withColumn("flow", F.explode(flows)), ["flow", "outcome"], n, cluster="pu")


@query("did_od_flow", _od_final, "coef se t:4", {**_OD, **_od_ctes})
def did_od_flow(t):
    """The policy effect on origin-destination pairs by flow type."""
    return od_effects(t)


@query(
    "pass_through",
    f"""SELECT flow, max(coef) FILTER (WHERE outcome = 'rider_pt') AS d_rider_cost, max(coef) FILTER (WHERE outcome = 'cbd_pt') AS d_cbd,
         max(coef) FILTER (WHERE outcome = 'fare_pt') AS d_base_fare,
         max(coef) FILTER (WHERE outcome = 'rider_pt') / nullif(max(coef) FILTER (WHERE outcome = 'cbd_pt'), 0) AS pass_through_ratio
       FROM ({_od_final}) GROUP BY flow""",
    "d_rider_cost d_cbd d_base_fare pass_through_ratio:4",
    {**_OD, **_od_ctes},
)
def pass_through(t):
    """Share of the fee that reaches what riders pay."""

    def pick(y):
        return F.max(F.when(F.col("outcome") == y, F.col("coef")))

    wide = od_effects(t).groupBy("flow").agg(pick("rider_pt").alias("d_rider_cost"), pick("cbd_pt").alias("d_cbd"), pick("fare_pt").alias("d_base_fare"))
    return wide.withColumn("pass_through_ratio", ratio("d_rider_cost", "d_cbd"))


_CO = {
    "co_panel": """SELECT *, ln(greatest(n_uber, 1)) AS ln_uber, ln(greatest(n_lyft, 1)) AS ln_lyft, 100.0e0 * n_uber / nullif(n_uber + n_lyft, 0) AS uber_share FROM panel_week""",
    "co_long": long_sql("co_panel", ["ln_uber", "ln_lyft", "uber_share"], "zone, treat, post, wk"),
    "co_c": f"""SELECT outcome, zone AS cluster, treat, 1.0e0 AS w, avg(y) FILTER (WHERE post = 1) - avg(y) FILTER (WHERE post = 0) AS c FROM co_long
        GROUP BY ALL HAVING count(y) = {_N_WEEKS}""",
}
_co_ctes, _co_final = difference_sql("co_c", "outcome", _N_WEEKS)


def company_panel(t):
    floor = {f"ln_{c}": F.ln(F.greatest(F.col(f"n_{c}"), F.lit(1)).cast("double")) for c in ("uber", "lyft")}
    return t.panel_week.withColumns({**floor, "uber_share": 100.0 * ratio("n_uber", F.col("n_uber") + F.col("n_lyft"))})


@query("company_did", _co_final, "coef se t:4", {**_CO, **_co_ctes})
def company_did(t):
    """The policy effect per company and on the market share."""
    c, n = policy_contrasts(t, company_panel(t), "wk", ["ln_uber", "ln_lyft", "uber_share"])
    return contrasts.estimate(c, ["outcome"], n)


_SD = {
    **_CO,
    "sd_c": """SELECT 'uber_minus_lyft' AS outcome, zone AS cluster, treat, 1.0e0 AS w,
        avg(ln_uber - ln_lyft) FILTER (WHERE post = 1) - avg(ln_uber - ln_lyft) FILTER (WHERE post = 0) AS c FROM co_panel GROUP BY ALL""",
}
_sd_ctes, _ = difference_sql("sd_c", "outcome", _N_WEEKS)
_SD_ADJ = f"""SELECT outcome, coef, sqrt(g / (g - 1.0e0) * (nobs - 1) / greatest(nobs - 2 - (2 * nu + 2 * {_N_WEEKS} - 1), 1) * v) AS se, CAST(nobs AS BIGINT) AS n_obs
    FROM (SELECT *, 2 * nu * {_N_WEEKS} AS nobs FROM df_c JOIN df_v USING (outcome))"""


@query("stacked_diff", _SD_ADJ, "coef se", {**_SD, **_sd_ctes})
def stacked_diff(t):
    """Difference between the two companies' effects, from the stacked panel clustered by zone."""
    panel = company_panel(t)
    stacked = panel.select("zone", "wk", "treat", "post", F.col("ln_uber").alias("y"), F.lit(1.0).alias("sign")).unionByName(
        panel.select("zone", "wk", "treat", "post", F.col("ln_lyft").alias("y"), F.lit(-1.0).alias("sign"))
    )
    c, n = policy_contrasts(t, stacked.withColumn("unit", F.concat_ws("_", "zone", "sign")), "wk", ["y"], unit="unit", keep=("zone", "treat", "sign"))
    diff = c.groupBy("zone", "treat").agg(F.sum(F.col("sign") * F.col("c")).alias("c")).withColumn("outcome", F.lit("uber_minus_lyft"))
    s = contrasts.influences(diff, ["outcome"], "treat", "zone").groupBy("outcome", "coef", "n_units").agg(
        F.sum(F.col("s") * F.col("s")).alias("v"), F.count(F.lit(1)).alias("g")
    )
    n_obs = 2 * F.col("n_units") * n
    adj = contrasts.clustered_adjustment(F.col("g"), n_obs, 2, 2 * F.col("n_units") + 2 * n - 1)
    return s.select("outcome", "coef", F.sqrt(adj * F.col("v")).alias("se"), n_obs.alias("n_obs"))


# ------------------------------------------------------------------ the whole robustness table
# (sample, condition on the week panel, specification); other rows come from other panels
_WEEK_SAMPLES = [
    ("base", "TRUE", "twfe"),
    ("near_controls", "treat = 1 OR grp = 'MN_NORTH'", "twfe"),
    ("far_controls", "treat = 1 OR grp = 'OUTER'", "twfe"),
    ("control_boroughs", "treat = 1 OR borough = 'ASIA'", "twfe"),
    ("floor_high", "w_pre >= 1", "twfe"),
    ("no_holidays", "NOT ((month(wk) = 12 AND day(wk) >= 20) OR (month(wk) = 1 AND day(wk) <= 5))", "twfe"),
    ("skip_4_weeks", "k < 0 OR k >= 4", "twfe"),
    ("first_half", "wk < DATE '2025-07-01'", "twfe"),
    ("second_half", "wk < DATE '2025-01-05' OR wk >= DATE '2025-07-01'", "twfe"),
    ("weighted", "TRUE", "weighted"),
    ("trend", "TRUE", "trend"),
    ("seasonal", "TRUE", "seasonal"),
    ("borough_clusters", "TRUE", "borough_clusters"),
]
TABLE_SPECS = (
    fe_batch.Spec("twfe", ("tp",), ("zone", "time"), "zone"),
    fe_batch.Spec("weighted", ("tp",), ("zone", "time"), "zone", "w_pre"),
    fe_batch.Spec("trend", ("tp", "trend"), ("zone", "time"), "zone"),
    fe_batch.Spec("seasonal", ("tp",), ("zone", "time", "tw"), "zone"),
    fe_batch.Spec("borough_week", ("tp",), ("zone", "bw"), "zone"),
    fe_batch.Spec("borough_clusters", ("tp",), ("zone", "time"), "borough"),
)
_TABLE_COLUMNS = "zone, CAST(wk AS VARCHAR) AS wk, treat, borough, w_pre, k, woy, ln_n, tp"
_MERGED = f"SELECT {_TABLE_COLUMNS.replace('treat,', 'CAST(treat = 1 OR grp = ' + chr(39) + 'CRZ_PARTIAL' + chr(39) + ' AS INTEGER) AS treat,').replace('ln_n, tp', 'ln_n, CAST(treat = 1 OR grp = ' + chr(39) + 'CRZ_PARTIAL' + chr(39) + ' AS INTEGER) * post AS tp')} FROM panel_week_all"
_TABLE = {
    # the week panel again, with a lower floor
    "low_keep": """SELECT zone, sum(n) FILTER (WHERE wk < DATE '2025-01-05') / 364.0e0 AS w_pre FROM panel_week_cells GROUP BY zone
        HAVING count(*) = (SELECT count(DISTINCT wk) FROM panel_week_cells) AND sum(n) FILTER (WHERE wk < DATE '2025-01-05') / 364.0e0 >= 0.25""",
    "low_panel": """SELECT zone, CAST(wk AS VARCHAR) AS wk, CAST(grp = 'CRZ' AS INTEGER) AS treat, borough, w_pre, 0 AS k, 0 AS woy, ln(n) AS ln_n,
        CAST(grp = 'CRZ' AS INTEGER) * CAST(wk >= DATE '2025-01-05' AS INTEGER) AS tp FROM panel_week_cells JOIN low_keep USING (zone)""",
    "merged_panel": _MERGED,
    "day_panel": "SELECT zone, CAST(d AS VARCHAR) AS wk, treat, borough, w_pre, 0 AS k, 0 AS woy, ln_n, tp FROM panel_day",
    "tab_all": " UNION ALL ".join(
        [f"SELECT '{s}' AS sample, '{spec}' AS spec, {_TABLE_COLUMNS} FROM panel_week WHERE {cond}" for s, cond, spec in _WEEK_SAMPLES]
        + [f"SELECT '{s}', '{spec}', * FROM {p}" for s, spec, p in (
            ("floor_low", "twfe", "low_panel"), ("straddling_treated", "twfe", "merged_panel"),
            ("borough_week", "borough_week", "merged_panel"), ("day_panel", "twfe", "day_panel"))]
    ),
    "tab_rows": """SELECT sample, spec, zone, CASE WHEN spec = 'borough_week' THEN borough || wk ELSE wk END AS wk,
        CASE WHEN spec = 'seasonal' THEN treat * 100 + woy ELSE 0 END AS tw, CASE WHEN spec = 'borough_clusters' THEN borough ELSE CAST(zone AS VARCHAR) END AS cluster,
        CASE WHEN spec = 'weighted' THEN w_pre ELSE 1.0e0 END AS w, ln_n AS y, CAST(tp AS DOUBLE) AS tp,
        CASE WHEN spec = 'trend' THEN treat * k / 52.0e0 ELSE 0.0e0 END AS tr FROM tab_all WHERE ln_n IS NOT NULL""",
}
_TABLE_SQL = f"""SELECT sample, spec, coef, sqrt(adj * meat) / stt AS se, CAST(n AS BIGINT) AS n_obs, CAST(g AS BIGINT) AS n_clusters FROM (
  WITH RECURSIVE tab_p AS (SELECT 0 AS i, * FROM tab_rows UNION ALL
    SELECT i + 1 AS i, sample, spec, zone, wk, tw, cluster, w, y, tp, tr FROM {_projection("sample, spec", ["y", "tp", "tr"], ["zone", "wk", "tw"], "tab_p", "cluster, ")} WHERE i < 30),
  tab_done AS (SELECT * FROM tab_p WHERE i = 30),
  tab_tr AS (SELECT sample, coalesce(sum(w * tp * tr) / nullif(sum(w * tr * tr), 0), 0) AS c, coalesce(sum(w * y * tr) / nullif(sum(w * tr * tr), 0), 0) AS cy FROM tab_done GROUP BY sample),
  tab_t AS (SELECT *, tp - c * tr AS tt FROM tab_done JOIN tab_tr USING (sample)),
  tab_b AS (SELECT sample, sum(w * tt * y) / sum(w * tt * tt) AS coef, sum(w * tt * tt) AS stt FROM tab_t GROUP BY sample),
  tab_s AS (SELECT sample, cluster, sum(w * tt * (y - cy * tr - coef * tt)) AS s FROM tab_t JOIN tab_b USING (sample) GROUP BY sample, cluster),
  tab_m AS (SELECT sample, sum(s * s) AS meat, count(*) AS g FROM tab_s GROUP BY sample),
  tab_n AS (SELECT sample, spec, count(*) AS n, count(DISTINCT zone) + count(DISTINCT wk) - 1 + CASE WHEN spec = 'seasonal' THEN count(DISTINCT tw) - 1 ELSE 0 END AS levels
            FROM tab_done GROUP BY sample, spec)
  SELECT *, g / (g - 1.0e0) * (n - 1) / greatest(n - CASE WHEN spec = 'trend' THEN 2 ELSE 1 END - levels, 1) AS adj FROM tab_b JOIN tab_m USING (sample) JOIN tab_n USING (sample))"""


@query("robustness_table", _TABLE_SQL, "coef se:5", _TABLE)
def robustness_table(t):
    """Seventeen choices of sample, effects, weights and clusters, fitted together."""
    columns = ["zone", "time", "treat", "borough", "w_pre", "k", "woy", "ln_n", "tp"]
    week = t.panel_week.withColumn("time", F.col("wk").cast("string"))
    picked = F.filter(
        F.array(*[F.when(F.expr(cond), F.struct(F.lit(s).alias("sample"), F.lit(spec).alias("want"))) for s, cond, spec in _WEEK_SAMPLES]), lambda x: x.isNotNull()
    )
    rows = week.select(*columns, F.inline(picked))
    zeros = [F.lit(0).alias("k"), F.lit(0).alias("woy")]
    low = panels.zone_week(t.gold("zone_day_pu"), t.dim_zone, None, min_daily=MIN_DAILY / 2).withColumn("time", F.col("wk").cast("string"))
    treated = flag((F.col("treat") == 1) | (F.col("grp") == "CRZ_PARTIAL"))
    merged = t.panel_week_all.withColumns({"time": F.col("wk").cast("string"), "treat": treated}).withColumn("tp", F.col("treat") * F.col("post"))
    day = t.panel_day.withColumn("time", F.col("d").cast("string")).select(*[c for c in columns if c not in ("k", "woy")], *zeros)
    for sample, want, panel in (("floor_low", "twfe", low), ("straddling_treated", "twfe", merged), ("borough_week", "borough_week", merged), ("day_panel", "twfe", day)):
        rows = rows.unionByName(panel.select(*columns, F.lit(sample).alias("sample"), F.lit(want).alias("want")))
    rows = rows.withColumns({"trend": F.col("treat") * F.col("k") / 52.0, "tw": F.concat_ws("_", "treat", "woy"), "bw": F.concat("borough", "time")})
    fits = fe_batch.fe_ols_batch(rows, ["ln_n"], TABLE_SPECS, by=("sample", "want"), only=F.col("spec") == F.col("want"))
    return fits.where("term = 'tp'").select("sample", "spec", "coef", "se", "n_obs", "n_clusters")


# ------------------------------------------------------------------ robustness
_SAMPLES = {
    "base": ("TRUE", "TRUE"),
    "near_controls": ("treat = 1 OR grp = 'MN_NORTH'", "TRUE"),
    "far_controls": ("treat = 1 OR grp = 'OUTER'", "TRUE"),
    "no_holidays": ("TRUE", "NOT ((month(wk) = 12 AND day(wk) >= 20) OR (month(wk) = 1 AND day(wk) <= 5))"),
    "skip_4_weeks": ("TRUE", "k < 0 OR k >= 4"),
    "first_half": ("TRUE", "wk < DATE '2025-07-01'"),
    "second_half": ("TRUE", "wk < DATE '2025-01-05' OR wk >= DATE '2025-07-01'"),
    "large_zones": ("w_pre >= 1", "TRUE"),
}
_RB = {
    "rb_rows": " UNION ALL ".join(f"SELECT '{s}' AS sample, zone, treat, post, ln_n AS y, wk FROM panel_week WHERE ({u}) AND ({p})" for s, (u, p) in _SAMPLES.items()),
    "rb_t": "SELECT sample, count(DISTINCT wk) AS periods FROM rb_rows GROUP BY sample",
    "rb_c": "SELECT sample, zone AS cluster, treat, 1.0e0 AS w, avg(y) FILTER (WHERE post = 1) - avg(y) FILTER (WHERE post = 0) AS c FROM rb_rows GROUP BY ALL",
}
_rb_ctes, _rb_final = difference_sql("rb_c", "sample", "(SELECT periods FROM rb_t WHERE rb_t.sample = df_c.sample)")


@query("robustness_samples", _rb_final, "coef se t:4", {**_RB, **_rb_ctes})
def robustness_samples(t):
    """The main estimate under several samples of zones and weeks."""
    panel, out = t.panel_week, None
    for name, (units, weeks) in _SAMPLES.items():
        sub = panel.where(units).where(weeks)
        c, n = policy_contrasts(t, sub, "wk", ["ln_n"])
        one = contrasts.estimate(c, ["outcome"], n).withColumn("sample", F.lit(name)).drop("outcome")
        out = one if out is None else out.unionByName(one)
    return out


_PL = {
    "pl_long": long_sql("(SELECT * FROM panel_week WHERE wk < DATE '2025-01-05')", OUTCOMES, "zone, treat, wk"),
    "pl_c": """SELECT outcome, zone AS cluster, treat, 1.0e0 AS w, avg(y) FILTER (WHERE wk >= DATE '2024-07-07') - avg(y) FILTER (WHERE wk < DATE '2024-07-07') AS c
        FROM pl_long GROUP BY ALL""",
}
_pl_ctes, _pl_final = difference_sql("pl_c", "outcome", "(SELECT count(DISTINCT wk) FROM pl_long)")


@query("placebo_time", _pl_final, "coef se t:4", {**_PL, **_pl_ctes})
def placebo_time(t):
    """A fake policy date inside the pre-period."""
    pre = t.panel_week.where("post = 0").withColumn("post", (F.col("wk") >= F.lit("2024-07-07").cast("date")).cast("int"))
    c, n = policy_contrasts(t, pre, "wk", OUTCOMES)
    return contrasts.estimate(c, ["outcome"], n)


_MD = {
    "md_rows": " UNION ALL ".join(f"SELECT {n} AS post_weeks, zone, treat, post, wk, ln_n AS y FROM panel_week WHERE k < {n}" for n in (4, 8, 13, 26, 39, 52)),
    "md_t": "SELECT post_weeks, count(DISTINCT wk) AS periods FROM md_rows GROUP BY ALL",
    "md_c": "SELECT post_weeks, zone AS cluster, treat, 1.0e0 AS w, avg(y) FILTER (WHERE post = 1) - avg(y) FILTER (WHERE post = 0) AS c FROM md_rows GROUP BY ALL",
}
_md_ctes, _md_final = difference_sql("md_c", "post_weeks", "(SELECT periods FROM md_t WHERE md_t.post_weeks = df_c.post_weeks)")


@query("mde_by_horizon", f"SELECT *, 2.8e0 * se AS mde80 FROM ({_md_final})", "coef se t:4 mde80", {**_MD, **_md_ctes})
def mde_by_horizon(t):
    """Smallest effect that six lengths of the post-period can detect."""
    panel, out = t.panel_week, None
    for weeks in (4, 8, 13, 26, 39, 52):
        c, n = policy_contrasts(t, panel.where(F.col("k") < weeks), "wk", ["ln_n"])
        one = contrasts.estimate(c, ["outcome"], n).drop("outcome").withColumn("post_weeks", F.lit(weeks))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("mde80", 2.8 * F.col("se"))


_UE = {
    "ue_c": "SELECT zone, treat, avg(ln_n) FILTER (WHERE post = 1) - avg(ln_n) FILTER (WHERE post = 0) AS c FROM panel_week GROUP BY ALL",
    "ue_pre": """SELECT zone, ln(CAST(sum(n) AS DOUBLE) / 364) AS ln_volume, 100.0e0 * sum(n_to_crz) / sum(n) AS share_to_crz, sum(fare) / sum(n) AS fare_pt_pre
        FROM panel_week WHERE post = 0 GROUP BY zone""",
    "ue": "SELECT zone, c - (SELECT avg(c) FROM ue_c WHERE treat = 0) AS coef, ln_volume, share_to_crz, fare_pt_pre FROM ue_c JOIN ue_pre USING (zone) WHERE treat = 1",
}


@query("unit_effects", "SELECT * FROM ue", "coef ln_volume share_to_crz fare_pt_pre", _UE)
def unit_effects(t):
    """One effect per treated zone, with its pre-period traits."""
    return unit_effect_table(t)


def unit_effect_table(t):
    c, _ = policy_contrasts(t, t.panel_week, "wk", ["ln_n"])
    control = c.where("treat = 0").agg(F.avg("c")).scalar()
    pre = t.panel_week.where("post = 0").groupBy("zone").agg(
        F.ln(F.sum("n").cast("double") / 364).alias("ln_volume"),
        (100.0 * ratio(F.sum("n_to_crz"), F.sum("n"))).alias("share_to_crz"),
        ratio(F.sum("fare"), F.sum("n")).alias("fare_pt_pre"),
    )
    return c.where("treat = 1").select("zone", (F.col("c") - control).alias("coef")).join(pre, "zone")


@query("spillover_bands")
def spillover_bands(t):
    """Effects by distance band to the treated area against the farthest band, for pick-ups."""
    from tripspark.plans.space import zone_distance

    bands = t.panel_week_all.join(zone_distance(t), "zone").withColumn("band", clean.distance_band("dist_km", "grp"))
    names = [r[0] for r in bands.select("band").distinct().orderBy("band").collect()]
    far = ">10 km" if ">10 km" in names else names[-1]
    xs = []
    for i, b in enumerate(n for n in names if n != far):
        bands = bands.withColumn(f"D_{i}", ((F.col("band") == b) & (F.col("post") == 1)).cast("double"))
        xs.append((f"D_{i}", b))
    fit = fixed_effects.fe_ols(bands, "ln_n", [x for x, _ in xs], ["zone", "wk"], "zone")
    label = dict(xs)
    rows = [(label[r["term"]], *list(r.values())[1:]) for r in fit.rows()]
    return t.spark.createDataFrame(rows, fixed_effects.ROW_SCHEMA.replace("term", "band", 1))


_SE = {
    "se_x": "SELECT zone, sum(n_to_crz) / CAST(sum(n) AS DOUBLE) AS x FROM panel_week_all WHERE post = 0 AND grp <> 'CRZ' GROUP BY zone",
    "se_c": "SELECT zone, avg(ln_n) FILTER (WHERE post = 1) - avg(ln_n) FILTER (WHERE post = 0) AS c FROM panel_week_all WHERE grp <> 'CRZ' GROUP BY zone",
    "se_fit": "SELECT regr_slope(c, x) AS b, regr_intercept(c, x) AS a, regr_sxx(c, x) AS sxx, count(*) AS g FROM se_c JOIN se_x USING (zone)",
}
_N_WA = "(SELECT count(DISTINCT wk) FROM panel_week_all)"


@query(
    "spillover_exposure",
    f"""SELECT b AS coef, sqrt(g / (g - 1.0e0) * (g * {_N_WA} - 1) / (g * {_N_WA} - 1 - (g + {_N_WA} - 1)) *
          (SELECT sum(pow((x - (SELECT avg(x) FROM se_x)) * (c - a - b * x), 2)) FROM se_c JOIN se_x USING (zone)) / (sxx * sxx)) AS se,
          CAST(g AS BIGINT) AS n_clusters FROM se_fit""",
    "coef se",
    _SE,
)
def spillover_exposure(t):
    """Effect outside the treated area per unit of exposure: share of pre-period trips into it."""
    panel = t.panel_week_all.where("grp <> 'CRZ'")
    exposure = panel.where("post = 0").groupBy("zone").agg(ratio(F.sum("n_to_crz"), F.sum("n")).alias("exposure"))
    data = panel.join(exposure, "zone").withColumn("post_x_exp", F.col("post") * F.col("exposure"))
    fit = fixed_effects.fe_ols(data, "ln_n", ["post_x_exp"], ["zone", "wk"], "zone")
    return t.spark.createDataFrame([(r["coef"], r["se"], r["n_clusters"]) for r in fit.rows()], "coef double, se double, n_clusters long")


@query("pay_mechanical")
def pay_mechanical(t):
    """Pay per mile as a price per minute times minutes per mile: predicted against estimated change."""
    panel = t.panel_week
    pre = panel.where("post = 0").withColumn("min_pm", ratio(F.col("time_s") / 60.0, "miles"))
    slope = fixed_effects.fe_ols(pre, "fare_pm", ["min_pm"], ["zone", "wk"], "zone")
    c, n = policy_contrasts(t, panel, "wk", ["mph", "fare_pm"])
    est = {r["outcome"]: r["coef"] for r in contrasts.estimate(c, ["outcome"], n).collect()}
    mph0 = panel.where("treat = 1 AND post = 0").agg(F.avg("mph")).first()[0]
    row = slope.rows()[0]
    predicted = row["coef"] * 60.0 * (1 / (mph0 + est["mph"]) - 1 / mph0)
    return t.spark.createDataFrame(
        [(row["coef"], row["se"], mph0, est["mph"], predicted, est["fare_pm"], row["within_r2"], row["n_obs"])],
        "b_pay_per_minute double, b_se double, mph_pre double, d_mph double, predicted double, estimated double, within_r2 double, n_obs long",
    )


_PE = {
    "pe_rows": "SELECT zone, ym, grp, substr(ym, 1, 4) AS yr, ln(fare / miles) AS y, ln(n) AS x1, ln(miles / (time_s / 3600.0e0)) AS x2 FROM (SELECT * FROM zone_hour_month WHERE service = 'hvfhv' AND ym BETWEEN '2024-01' AND '2025-12' AND n >= 2) JOIN dim_zone USING (zone) WHERE grp IN ('CRZ', 'MN_NORTH', 'OUTER')",
    "pe_dm": """SELECT grp, yr, zone, ym, y - avg(y) OVER w AS y, x1 - avg(x1) OVER w AS x1, x2 - avg(x2) OVER w AS x2 FROM pe_rows WINDOW w AS (PARTITION BY zone, ym)""",
    "pe_s": "SELECT grp, yr, sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x2 * x2) AS d, sum(x1 * y) AS e, sum(x2 * y) AS f, count(*) AS n_obs FROM pe_dm GROUP BY ALL",
}


@query(
    "price_elasticity",
    "SELECT grp, yr, (d * e - b * f) / (a * d - b * b) AS b_ln_n, (a * f - b * e) / (a * d - b * b) AS b_ln_mph, CAST(n_obs AS BIGINT) AS n_obs FROM pe_s",
    "b_ln_n b_ln_mph",
    _PE,
)
def price_elasticity(t):
    """Price on volume and speed inside zone-months, by group and year: one-way demeaning and two sums of products."""
    h = t.gold("zone_hour_month").where("service = 'hvfhv' AND ym BETWEEN '2024-01' AND '2025-12' AND n >= 2")
    h = h.join(t.dim_zone.where("grp IN ('CRZ', 'MN_NORTH', 'OUTER')").select("zone", "grp"), "zone").select(
        "grp",
        F.substring("ym", 1, 4).alias("yr"),
        F.concat_ws("_", "zone", "ym").alias("zm"),
        safe_ln(ratio("fare", "miles")).alias("y"),
        safe_ln("n").alias("x1"),
        safe_ln(ratio("miles", F.col("time_s") / 3600.0)).alias("x2"),
    )
    d = fixed_effects.within_one(h, ["y", "x1", "x2"], "zm")
    s = d.groupBy("grp", "yr").agg(
        *[F.sum(F.col(p) * F.col(q)).alias(n) for n, p, q in (("a", "x1", "x1"), ("b", "x1", "x2"), ("d", "x2", "x2"), ("e", "x1", "y"), ("f", "x2", "y"))],
        F.count(F.lit(1)).alias("n_obs"),
    )
    det = F.col("a") * F.col("d") - F.col("b") * F.col("b")
    return s.select(
        "grp", "yr",
        F.try_divide(F.col("d") * F.col("e") - F.col("b") * F.col("f"), det).alias("b_ln_n"),
        F.try_divide(F.col("a") * F.col("f") - F.col("b") * F.col("e"), det).alias("b_ln_mph"),
        "n_obs",
    )
