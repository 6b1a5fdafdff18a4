"""Synthetic control, doubly robust learning, dose response, regressions and forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tripspark.config import SEED
from tripspark.functions.exprs import flag, ratio, safe_ln
from tripspark.operators import clean, contrasts, dml, forecast, regression, reshape, scm, timeops
from tripspark.plans.causal import difference_sql, policy_contrasts
from tripspark.plans.describe import SPEED_DID, speed_did
from tripspark.plans.inference import u_sql
from tripspark.plans.registry import query
from tripspark.session import checkpointed

FEE = 1.5


# ------------------------------------------------------------------ synthetic control
def _scm(t, demean, targets=None):
    series = scm.index_series(t.panel_week.withColumn("zone", F.col("zone").cast("long")))
    who = series.where("u = -1").select("u").distinct() if targets is None else targets
    weights = checkpointed(scm.weights_for(series, who, "wk", demean))
    return series, weights, scm.synthetic_series(series, weights, "wk", demean)


@query("synthetic_control")
def synthetic_control(t):
    """Fit and effect of the synthetic control, plain and demeaned."""
    out = []
    for name, demean in (("standard", False), ("demeaned", True)):
        _, weights, series = _scm(t, demean)
        positive = weights.agg(F.sum(flag(F.col("weight") > 1e-3)).alias("n")).scalar()
        out.append(scm.fit_summary(series).select(F.lit(name).alias("variant"), "*", positive.alias("n_donors_positive")))
    return out[0].unionByName(out[1])


@query("scm_placebo")
def scm_placebo(t):
    """The same fit for the largest donors in turn, and the rank p-values."""
    panel = t.panel_week
    donors = panel.where("treat = 0 AND post = 0").groupBy(F.col("zone").cast("long").alias("u")).agg(F.avg("n").alias("v"))
    targets = reshape.top_k(donors, "v", 60, "u").select("u").unionByName(t.spark.createDataFrame([(-1,)], "u long"))
    _, _, series = _scm(t, True, targets)
    return scm.placebo_p(scm.fit_summary(series))


# ------------------------------------------------------------------ pair-level learning table
_XS = ["ln_n_2024", "miles_pt", "min_pt", "tips_pt", "uber_share", "night_share", "same_zone"]
_BORO = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]
_DML = {
    "dm_agg": """SELECT pu, dl, """
    + ", ".join(
        f"sum({c}) FILTER (WHERE ym BETWEEN '{y}-01' AND '{y}-12') AS {c}_{y}" for c in ("n", "fare", "miles", "time_s", "tips") for y in (2024, 2025)
    )
    + " FROM od_month GROUP BY ALL",
    "dm_smp": f"""SELECT pu, dl, avg(CASE WHEN company_code = 'HV0003' THEN 1.0e0 ELSE 0.0e0 END) AS uber_share, avg(CASE WHEN hr <= 5 OR hr >= 22 THEN 1.0e0 ELSE 0.0e0 END) AS night_share,
        CAST(count(*) AS BIGINT) AS n_sample FROM silver WHERE service = 'hvfhv' AND year(d) = 2024 GROUP BY ALL""",
    "dm_raw": """SELECT a.pu, a.dl, ln(n_2024) AS ln_n_2024, ln(n_2025) - ln(n_2024) AS dlog_n, miles_2025 / (time_s_2025 / 3600.0e0) - miles_2024 / (time_s_2024 / 3600.0e0) AS d_mph,
        fare_2025 / miles_2025 - fare_2024 / miles_2024 AS d_fare_pm, miles_2024 / n_2024 AS miles_pt, time_s_2024 / n_2024 / 60.0e0 AS min_pt, tips_2024 / n_2024 AS tips_pt,
        uber_share, night_share, n_sample, CAST(a.pu = a.dl AS INTEGER) AS same_zone, CAST(zp.grp = 'CRZ' OR zd.grp = 'CRZ' AS INTEGER) AS tr,
        CASE WHEN zp.grp = 'CRZ' AND zd.grp = 'CRZ' THEN 'inside' WHEN zp.grp = 'CRZ' THEN 'outbound' WHEN zd.grp = 'CRZ' THEN 'inbound' ELSE 'none' END AS ftype, zp.borough AS pb
        FROM dm_agg AS a LEFT JOIN dm_smp AS s ON a.pu = s.pu AND a.dl = s.dl JOIN dim_zone AS zp ON a.pu = zp.zone JOIN dim_zone AS zd ON a.dl = zd.zone
        WHERE zp.grp IN ('CRZ', 'MN_NORTH', 'OUTER') AND zd.grp IN ('CRZ', 'MN_NORTH', 'OUTER') AND n_2024 >= 3 AND n_2025 > 0""",
    "dm": "SELECT pu, dl, tr, ftype, same_zone, n_sample, dlog_n, d_mph, d_fare_pm, ln_n_2024, miles_pt, min_pt, tips_pt,"
    " coalesce(uber_share, (SELECT quantile_cont(uber_share, 0.5) FROM dm_raw)) AS uber_share, coalesce(night_share, (SELECT quantile_cont(night_share, 0.5) FROM dm_raw)) AS night_share, "
    + ", ".join(f"CAST(pb = '{b}' AS INTEGER) AS pb_{b}" for b in _BORO)
    + " FROM dm_raw",
}


def dml_table(t):
    def build():
        m = t.gold("od_month")
        aggs = [
            F.sum(F.when(F.col("ym").between(f"{y}-01", f"{y}-12"), F.col(c))).alias(f"{c}_{y}")
            for c in ("n", "fare", "miles", "time_s", "tips")
            for y in (2024, 2025)
        ]
        a = m.groupBy("pu", "dl").agg(*aggs).where("n_2024 >= 3 AND n_2025 > 0")
        s = t.trips.where("service = 'hvfhv' AND year = 2024").groupBy("pu", "dl").agg(
            F.avg(flag(F.col("company_code") == "HV0003").cast("double")).alias("uber_share"),
            F.avg(flag((F.col("hr") <= 5) | (F.col("hr") >= 22)).cast("double")).alias("night_share"),
            F.count(F.lit(1)).alias("n_sample"),
        )
        z = t.dim_zone.where("grp IN ('CRZ', 'MN_NORTH', 'OUTER')")
        df = a.join(z.select(F.col("zone").alias("pu"), F.col("grp").alias("pu_grp"), F.col("borough").alias("pb")), "pu")
        df = df.join(z.select(F.col("zone").alias("dl"), F.col("grp").alias("do_grp")), "dl").join(s, ["pu", "dl"], "left")

        def mph(y):
            return ratio(f"miles_{y}", F.col(f"time_s_{y}") / 3600.0)

        df = df.select(
            "pu", "dl", flag((F.col("pu_grp") == "CRZ") | (F.col("do_grp") == "CRZ")).alias("tr"), clean.flow_type().alias("ftype"),
            flag(F.col("pu") == F.col("dl")).alias("same_zone"), "n_sample",
            (safe_ln("n_2025") - safe_ln("n_2024")).alias("dlog_n"), (mph(2025) - mph(2024)).alias("d_mph"),
            (ratio("fare_2025", "miles_2025") - ratio("fare_2024", "miles_2024")).alias("d_fare_pm"),
            safe_ln("n_2024").alias("ln_n_2024"), ratio("miles_2024", "n_2024").alias("miles_pt"), (ratio("time_s_2024", "n_2024") / 60.0).alias("min_pt"),
            ratio("tips_2024", "n_2024").alias("tips_pt"), "uber_share", "night_share", "pb",
        )
        filled = clean.impute_median(df, ["uber_share", "night_share"])
        return clean.dummies(filled, "pb", _BORO, "pb_").drop("pb")

    return t._stored("dml", build)


_DM_NUM = "dlog_n d_mph d_fare_pm ln_n_2024 miles_pt min_pt tips_pt uber_share night_share"


@query("dml_dataset", "SELECT * FROM dm", _DM_NUM + " n_sample:0", _DML)
def dml_dataset(t):
    """Pair-level table: changes, features before the policy, exact shares, borough dummies, median fill."""
    return dml_table(t)


# nuisance values that SQL can make too: means by distance bin
_NU = {
    **_DML,
    "nu": """SELECT *, least(floor(miles_pt / 4), 7) AS bin FROM dm""",
    "nuis": """SELECT *, avg(CAST(tr AS DOUBLE)) OVER b * 0.8e0 + 0.1e0 AS e, avg(dlog_n) OVER b AS g, coalesce(avg(dlog_n) FILTER (WHERE tr = 1) OVER b, 0) AS mu1,
        coalesce(avg(dlog_n) FILTER (WHERE tr = 0) OVER b, 0) AS mu0 FROM nu WINDOW b AS (PARTITION BY bin)""",
    "sc0": "SELECT *, least(greatest(e, 0.05), 0.95) AS ec FROM nuis",
    "sc": "SELECT *, mu1 - mu0 + tr * (dlog_n - mu1) / ec - (1 - tr) * (dlog_n - mu0) / (1 - ec) AS phi, mu1 - mu0 + 0.01e0 * min_pt - 0.02e0 * tips_pt AS tau FROM sc0",
}


def given_nuisance(t):
    df = dml_table(t).withColumn("bin", F.least(F.floor(F.col("miles_pt") / 4), F.lit(7)))
    m = df.groupBy("bin").agg(
        (F.avg(F.col("tr").cast("double")) * 0.8 + 0.1).alias("e"),
        F.avg("dlog_n").alias("g"),
        F.coalesce(F.avg(F.when(F.col("tr") == 1, F.col("dlog_n"))), F.lit(0.0)).alias("mu1"),
        F.coalesce(F.avg(F.when(F.col("tr") == 0, F.col("dlog_n"))), F.lit(0.0)).alias("mu0"),
    )
    df = df.join(m, "bin")
    df = df.withColumn("phi", dml.aipw_score("dlog_n", "tr", dml.clip("e", 0.05), "mu1", "mu0"))
    return df.withColumn("tau", F.col("mu1") - F.col("mu0") + 0.01 * F.col("min_pt") - 0.02 * F.col("tips_pt"))


@query(
    "plr_from_nuisance",
    """SELECT theta AS plr_theta, sqrt(avg(pow((ry - theta * rd) * rd, 2)) / pow(avg(rd * rd), 2) / count(*)) AS plr_se, CAST(count(*) AS BIGINT) AS n
       FROM (SELECT dlog_n - g AS ry, tr - e AS rd FROM nuis) CROSS JOIN (SELECT sum((tr - e) * (dlog_n - g)) / sum((tr - e) * (tr - e)) AS theta FROM nuis) GROUP BY theta""",
    "plr_theta plr_se",
    _NU,
)
def plr_from_nuisance(t):
    """Partially linear estimate from given nuisances."""
    return dml.plr(given_nuisance(t), "dlog_n", "tr", "g", "e")


@query(
    "aipw_from_nuisance",
    """SELECT avg(phi) AS aipw_ate, stddev_samp(phi) / sqrt(count(*)) AS aipw_se,
         avg((tr - (1 - tr) * ec / (1 - ec)) * (dlog_n - mu0)) / avg(CAST(tr AS DOUBLE)) AS aipw_att,
         (SELECT avg(dlog_n) FILTER (WHERE tr = 1) - avg(dlog_n) FILTER (WHERE tr = 0) FROM sc) AS naive_diff, CAST(count(*) AS BIGINT) AS n_used
       FROM sc WHERE e BETWEEN 0.05 AND 0.95""",
    "aipw_ate aipw_se aipw_att naive_diff",
    _NU,
)
def aipw_from_nuisance(t):
    """Doubly robust estimates from given nuisances."""
    return dml.aipw(given_nuisance(t), "dlog_n", "tr", "e", "mu1", "mu0")


_GATE_CTES = {
    **_NU,
    "gt_e": "SELECT quantile_cont(tau, [0.2, 0.4, 0.6, 0.8]) AS q FROM sc",
    "gt": "SELECT sc.*, CAST(1 + CAST(tau > q[1] AS INTEGER) + CAST(tau > q[2] AS INTEGER) + CAST(tau > q[3] AS INTEGER) + CAST(tau > q[4] AS INTEGER) AS INTEGER) AS qg FROM sc CROSS JOIN gt_e",
}
_TRAITS = ["miles_pt", "min_pt", "tips_pt", "ln_n_2024", "uber_share"]


@query(
    "gates_blp_clan",
    "SELECT 'gates' AS part, CAST(qg AS VARCHAR) AS item, avg(phi) AS value, stddev_samp(phi) / sqrt(count(*)) AS extra FROM gt GROUP BY qg"
    " UNION ALL SELECT 'blp', 'beta1', p, sqrt(sum(pow(phi - p - b * (tau - m), 2))) / count(*) FROM sc CROSS JOIN (SELECT avg(tau) AS m, avg(phi) AS p, regr_slope(phi, tau) AS b FROM sc) GROUP BY p"
    " UNION ALL SELECT 'blp', 'beta2', b, sqrt(sum(pow((tau - m) * (phi - p - b * (tau - m)), 2))) / sum(pow(tau - m, 2)) FROM sc CROSS JOIN (SELECT avg(tau) AS m, avg(phi) AS p, regr_slope(phi, tau) AS b FROM sc) GROUP BY b"
    + "".join(f" UNION ALL SELECT 'clan', '{c}', avg({c}) FILTER (WHERE qg = 1), avg({c}) FILTER (WHERE qg = 5) FROM gt" for c in _TRAITS),
    "value extra",
    _GATE_CTES,
)
def gates_blp_clan(t):
    """Group effects, best linear predictor and group traits for given effects and scores."""
    df = given_nuisance(t)
    g = dml.gates(df, "tau", "phi").select(F.lit("gates").alias("part"), F.col("grp").cast("string").alias("item"), F.col("gate").alias("value"), F.col("se").alias("extra"))
    b = dml.blp(df, "tau", "phi")
    rows = F.inline(F.array(*[F.struct(F.lit(f"beta{i}").alias("item"), F.col(f"beta{i}").alias("value"), F.col(f"se{i}").alias("extra")) for i in (1, 2)]))
    b = b.select(F.lit("blp").alias("part"), rows)
    c = dml.clan(df, "tau", _TRAITS).select(F.lit("clan").alias("part"), F.col("trait").alias("item"), F.col("low_group").alias("value"), F.col("high_group").alias("extra"))
    return g.unionByName(b).unionByName(c)


@query(
    "cate_by_bin",
    """SELECT 'distance' AS kind, CAST(bin8 AS VARCHAR) AS item, avg(tau) AS tau, CAST(count(*) AS BIGINT) AS n FROM (
         SELECT sc.*, 1 + """
    + " + ".join(f"CAST(miles_pt > q[{i}] AS INTEGER)" for i in range(1, 8))
    + """ AS bin8 FROM sc CROSS JOIN (SELECT quantile_cont(miles_pt, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS q FROM sc)) WHERE tr = 1 GROUP BY bin8
       UNION ALL SELECT 'flow', ftype, avg(tau), count(*) FROM sc GROUP BY ftype""",
    "tau",
    _NU,
)
def cate_by_bin(t):
    """Mean predicted effect by distance bin and by flow type."""
    df = given_nuisance(t)
    a = reshape.qcut(df, "miles_pt", 8, "bin8").where("tr = 1").groupBy(F.lit("distance").alias("kind"), F.col("bin8").cast("string").alias("item"))
    b = df.groupBy(F.lit("flow").alias("kind"), F.col("ftype").alias("item"))
    aggs = [F.avg("tau").alias("tau"), F.count(F.lit(1)).alias("n")]
    return a.agg(*aggs).unionByName(b.agg(*aggs))


def _trim_sql(label: str, low: str) -> str:
    return f"""SELECT '{label}' AS rule, CAST(count(*) AS BIGINT) AS n_used, CAST(sum(tr) AS BIGINT) AS n_treated, avg(phi) AS estimate, stddev_samp(phi) / sqrt(count(*)) AS se_iid,
        (SELECT sqrt(sum(s * s)) FROM (SELECT sum(phi - (SELECT avg(phi) FROM tq_{label})) AS s FROM tq_{label} GROUP BY pu)) / count(*) AS se_cluster FROM tq_{label}"""


def _trim_rows(low: str) -> str:
    return f"""SELECT pu, tr, mu1 - mu0 + tr * (dlog_n - mu1) / least(greatest(e, {low}), 1 - {low}) - (1 - tr) * (dlog_n - mu0) / (1 - least(greatest(e, {low}), 1 - {low})) AS phi
        FROM nuis WHERE e >= {low} AND e <= 1 - {low}"""


_CRUMP = "(SELECT a FROM tq_alpha)"
_TRIMS = {"t010": "0.01e0", "t025": "0.025e0", "t050": "0.05e0", "t100": "0.1e0", "crump": _CRUMP}
_TQ = {
    **_NU,
    "tq_h": "SELECT 1 / (e * (1 - e)) AS h FROM nuis",
    "tq_alpha": "SELECT coalesce(0.5 - sqrt(greatest(0.25 - 1 / max(h), 0)), 0) AS a FROM (SELECT h, avg(h) OVER (ORDER BY h RANGE UNBOUNDED PRECEDING) AS m FROM tq_h) WHERE h <= 2 * m",
    **{f"tq_{k}": _trim_rows(v).replace(_CRUMP, "(SELECT a FROM tq_alpha)") for k, v in _TRIMS.items()},
    "tq_num": "SELECT pu, tr, e * (1 - e) AS h, e * (1 - e) * (mu1 - mu0) + tr * (1 - e) * (dlog_n - mu1) - (1 - tr) * e * (dlog_n - mu0) AS num FROM nuis",
    "tq_psi": "SELECT pu, tr, (num - (SELECT sum(num) / sum(h) FROM tq_num) * h) / (SELECT avg(h) FROM tq_num) AS psi FROM tq_num",
}
_TRIM_SQL = " UNION ALL ".join(_trim_sql(k, v) for k, v in _TRIMS.items()) + (
    " UNION ALL SELECT 'ato', CAST(count(*) AS BIGINT), CAST(sum(tr) AS BIGINT), (SELECT sum(num) / sum(h) FROM tq_num), stddev_samp(psi) / sqrt(count(*)),"
    " (SELECT sqrt(sum(s * s)) FROM (SELECT sum(psi) AS s FROM tq_psi GROUP BY pu)) / count(*) FROM tq_psi"
)


@query("trim_crump_ato", _TRIM_SQL, "estimate se_iid se_cluster", _TQ)
def trim_crump_ato(t):
    """Sensitivity to trimming, Crump's threshold and overlap weights, clustered by origin."""
    df = given_nuisance(t)
    alpha = dml.crump_threshold(df, "e")
    lows = {"t010": 0.01, "t025": 0.025, "t050": 0.05, "t100": 0.1, "crump": alpha}
    parts = [dml.trimmed(df, "dlog_n", "tr", "e", "mu1", "mu0", "pu", low, label) for label, low in lows.items()]
    parts.append(dml.ato(df, "dlog_n", "tr", "e", "mu1", "mu0", "pu", "ato"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def cross_fitted(t, outcomes=("dlog_n",), xs=tuple(_XS), quadratic=False, learner="linear"):
    df = dml.with_folds(dml_table(t).fillna(0, ["n_sample"]), ["pu", "dl"], 5, SEED)
    return dml.cross_fit(df, list(outcomes), "tr", list(xs), 5, learner, quadratic, SEED)


@query("crossfit_nuisance")
def crossfit_nuisance(t):
    """Cross-fitted nuisances, then the partially linear and doubly robust estimates for two outcomes."""
    outcomes = ("dlog_n", "d_mph")
    df = cross_fitted(t, outcomes)
    parts = []
    for y in outcomes:
        a = dml.plr(df, y, "tr", f"g_{y}", "e_hat").drop("n")
        b = dml.aipw(df, y, "tr", "e_hat", f"mu1_{y}", f"mu0_{y}")
        parts.append(a.select(F.lit(y).alias("outcome"), F.lit(1).alias("_j"), "*").join(b.withColumn("_j", F.lit(1)), "_j").drop("_j"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("dr_learner")
def dr_learner(t):
    """Second cross-fit of the doubly robust score; group effects by quintile of the prediction."""
    df = cross_fitted(t).where(dml.overlap("e_hat", 0.05))
    df = df.withColumn("phi", dml.aipw_score("dlog_n", "tr", dml.clip("e_hat", 0.05), "mu1_dlog_n", "mu0_dlog_n"))
    df = df.drop("g_dlog_n", "mu1_dlog_n", "mu0_dlog_n", "e_hat", "fold")
    second = dml.cross_fit(dml.with_folds(df, ["pu", "dl"], 5, SEED + 1), ["phi"], "tr", _XS, 5, "linear", False, SEED)
    return dml.gates(second, "g_phi", "phi")


@query("dml_sensitivity")
def dml_sensitivity(t):
    """Two covariate sets: accuracy of the propensity, overlap and estimates."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = []
    for name, xs in (("short", _XS), ("full", [*_XS, *[f"pb_{b}" for b in _BORO]])):
        df = cross_fitted(t, xs=tuple(xs))
        vec = df.withColumn("raw", array_to_vector(F.array(1 - F.col("e_hat"), F.col("e_hat"))))
        auc = BinaryClassificationEvaluator(labelCol="tr", rawPredictionCol="raw").evaluate(vec)
        est = dml.plr(df, "dlog_n", "tr", "g_dlog_n", "e_hat").first()
        ai = dml.aipw(df, "dlog_n", "tr", "e_hat", "mu1_dlog_n", "mu0_dlog_n").first()
        rows.append((name, len(xs), float(auc), ai["n_used"], est["plr_theta"], est["plr_se"], ai["aipw_ate"], ai["aipw_se"]))
    return t.spark.createDataFrame(rows, "x_set string, n_features int, auc_propensity double, n_overlap long, plr_theta double, plr_se double, aipw_ate double, aipw_se double")


# ------------------------------------------------------------------ dose response and simple regressions
_N_OQ = "(SELECT count(DISTINCT period) FROM panel_od)"
_DR = {
    "ds_p0": f"SELECT pair, pu, treat, sum(rider_cost) / sum(n) AS p0, {FEE} / (sum(rider_cost) / sum(n)) AS share FROM panel_od WHERE post = 0 GROUP BY ALL",
    "ds_e": "SELECT quantile_cont(share, [0.2, 0.4, 0.6, 0.8]) AS q FROM ds_p0 WHERE treat = 1",
    "ds_q": "SELECT pair, p0, 1 + CAST(share > q[1] AS INTEGER) + CAST(share > q[2] AS INTEGER) + CAST(share > q[3] AS INTEGER) + CAST(share > q[4] AS INTEGER) AS qn FROM ds_p0 CROSS JOIN ds_e WHERE treat = 1",
    "ds_u": "SELECT pair, pu, treat, avg(ln_n) FILTER (WHERE post = 1) - avg(ln_n) FILTER (WHERE post = 0) AS c FROM panel_od GROUP BY ALL",
    "ds_c": """SELECT qn AS quintile, pu AS cluster, treat, 1.0e0 AS w, c FROM ds_u JOIN ds_q USING (pair)
        UNION ALL SELECT g.q, pu, treat, 1.0e0, c FROM ds_u CROSS JOIN (SELECT unnest(range(1, 6)) AS q) AS g WHERE treat = 0""",
}
_ds_ctes, _ds_final = difference_sql("ds_c", "quintile", _N_OQ)


@query(
    "dose_response",
    f"""SELECT CAST(quintile AS INTEGER) AS quintile, pairs, p0_mean, {FEE} / p0_mean AS fee_share, coef, se, -coef / ln(1 + {FEE} / p0_mean) AS implied_elasticity
        FROM ({_ds_final}) JOIN (SELECT qn AS quintile, CAST(count(*) AS BIGINT) AS pairs, avg(p0) AS p0_mean FROM ds_q GROUP BY 1) USING (quintile)""",
    "p0_mean fee_share coef se implied_elasticity:4",
    {**_DR, **_ds_ctes},
)
def dose_response(t):
    """Effects by quintile of the fee's share in the price, with the implied elasticity."""
    p0 = t.panel_od.where("post = 0").groupBy("pair", "treat").agg(ratio(F.sum("rider_cost"), F.sum("n")).alias("p0"))
    bins = reshape.qcut(p0.where("treat = 1").withColumn("share", FEE / F.col("p0")), "share", 5, "quintile").select("pair", "p0", "quintile")
    c, n = policy_contrasts(t, t.panel_od, "period", ["ln_n"], unit="pair", keep=("treat", "pu"))
    controls = c.where("treat = 0").withColumn("quintile", F.explode(F.sequence(F.lit(1), F.lit(5))))
    rows = c.join(bins.select("pair", "quintile"), "pair").unionByName(controls)
    est = contrasts.estimate(rows, ["quintile"], n, cluster="pu")
    traits = bins.groupBy("quintile").agg(F.count(F.lit(1)).alias("pairs"), F.avg("p0").alias("p0_mean"))
    out = est.join(traits, "quintile").withColumn("fee_share", FEE / F.col("p0_mean"))
    return out.select("quintile", "pairs", "p0_mean", "fee_share", "coef", "se", (-F.col("coef") / F.ln(1 + F.col("fee_share"))).alias("implied_elasticity"))


_MR = {
    "mr_c": "SELECT zone, any_value(w_pre) AS w, avg(ln_n) FILTER (WHERE post = 1) - avg(ln_n) FILTER (WHERE post = 0) AS y, 100.0e0 * sum(n_to_crz) FILTER (WHERE post = 0) / sum(n) FILTER (WHERE post = 0) AS x FROM panel_week GROUP BY zone",
    "mr_m": "SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, count(*) AS n FROM mr_c",
    "mr_b": "SELECT sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS b, sum(w * (x - mx) * (x - mx)) AS sxx FROM mr_c CROSS JOIN mr_m",
}


@query(
    "meta_regression",
    "SELECT any_value(b) AS coef, sqrt(any_value(n) / (any_value(n) - 2.0e0) * sum(pow(w * (x - mx) * (y - my - b * (x - mx)), 2))) / any_value(sxx) AS se, CAST(any_value(n) AS BIGINT) AS n FROM mr_c CROSS JOIN mr_m CROSS JOIN mr_b",
    "coef se",
    _MR,
)
def meta_regression(t):
    """Zone effects on the share of trips into the treated area, weighted, with robust errors."""
    return regression.wls_hc1(meta_rows(t), "c", ["share_to_crz"], "w_pre").where("term = 'share_to_crz'").select("coef", "se", "n")


def meta_rows(t):
    c, _ = policy_contrasts(t, t.panel_week, "wk", ["ln_n"], keep=("treat", "w_pre"))
    pre = t.panel_week.where("post = 0").groupBy("zone").agg(
        (100.0 * ratio(F.sum("n_to_crz"), F.sum("n"))).alias("share_to_crz"), safe_ln(F.sum("n")).alias("ln_volume"), ratio(F.sum("fare"), F.sum("n")).alias("fare_pt")
    )
    return c.join(pre, "zone")


@query("meta_regression_full")
def meta_regression_full(t):
    """The same regression with three traits."""
    return regression.wls_hc1(meta_rows(t), "c", ["share_to_crz", "ln_volume", "fare_pt"], "w_pre")


_HC = {
    **SPEED_DID,
    "hc_vol": """SELECT CASE WHEN isodow(d) >= 6 THEN 'weekend' ELSE 'weekday' END AS daytype, hr, sum(n) / CAST(count(DISTINCT d) AS DOUBLE) AS v
        FROM grp_hour_day WHERE service = 'hvfhv' AND pu_grp = 'CRZ' AND do_grp = 'CRZ' AND d < DATE '2025-01-05' GROUP BY ALL""",
    "hc": "SELECT did_vs_outer AS y, v / (SELECT max(v) FROM speed_did JOIN hc_vol USING (daytype, hr)) AS x FROM speed_did JOIN hc_vol USING (daytype, hr)",
    "hc_ok": "SELECT x, y FROM hc WHERE x IS NOT NULL AND y IS NOT NULL",
    "hc_b": "SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, avg(x) AS mx, count(*) AS n, regr_r2(y, x) AS r2 FROM hc_ok",
}


def speed_and_flow(t):
    g = t.gold("grp_hour_day").where("service = 'hvfhv' AND pu_grp = 'CRZ' AND do_grp = 'CRZ' AND d < DATE'2025-01-05'")
    g = g.withColumn("daytype", F.when(F.weekday("d") >= 5, "weekend").otherwise("weekday"))
    vol = g.groupBy("daytype", "hr").agg(ratio(F.sum("n"), F.countDistinct("d")).alias("v"))
    both = speed_did(t).join(vol, ["daytype", "hr"])
    top = both.agg(F.max("v")).scalar()
    return both.select("daytype", "hr", F.col("did_vs_outer").alias("y"), F.try_divide("v", top).alias("x"))


@query(
    "ols_hc1",
    "SELECT any_value(b) AS coef, sqrt(any_value(n) / (any_value(n) - 2.0e0) * sum(pow((x - mx) * (y - a - b * x), 2))) / any_value(sxx) AS se, any_value(r2) AS r2, CAST(any_value(n) AS BIGINT) AS n FROM hc_ok CROSS JOIN hc_b",
    "coef:5 se:5 r2",
    _HC,
)
def ols_hc1(t):
    """Speed gain on relative flow, with robust errors."""
    return regression.wls_hc1(speed_and_flow(t), "y", ["x"]).where("term = 'x'").select("coef", "se", "r2", "n")


@query("ols_hc1_models")
def ols_hc1_models(t):
    """Linear, quadratic and weekend-adjusted versions."""
    df = speed_and_flow(t).withColumns({"x2": F.col("x") * F.col("x"), "weekend": flag(F.col("daytype") == "weekend")})
    parts = [regression.wls_hc1(df, "y", xs).withColumn("model", F.lit("+".join(xs))) for xs in (["x"], ["x", "x2"], ["x", "weekend"])]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "spearman",
    """SELECT service, corr(rx, ry) AS spearman_rho, CAST(count(*) AS BIGINT) AS n FROM (
         SELECT service, rank() OVER (PARTITION BY service ORDER BY n) + (count(*) OVER (PARTITION BY service, n) - 1) / 2.0e0 AS rx,
           rank() OVER (PARTITION BY service ORDER BY n_cbd) + (count(*) OVER (PARTITION BY service, n_cbd) - 1) / 2.0e0 AS ry
         FROM (SELECT service, zone, sum(n) AS n, sum(n_cbd) AS n_cbd FROM zone_day_pu GROUP BY ALL)) GROUP BY service""",
    "spearman_rho",
)
def spearman(t):
    """Rank correlation of volume and charged trips over zones."""
    z = t.gold("zone_day_pu").groupBy("service", "zone").agg(F.sum("n").alias("n"), F.sum("n_cbd").alias("n_cbd"))
    return regression.spearman(z, "n", "n_cbd", ["service"])


# ------------------------------------------------------------------ forecasts
def daily_wide(t):
    g = t.gold("zone_day_pu").join(t.dim_zone.select("zone", "grp"), "zone").where("d BETWEEN DATE'2022-01-01' AND DATE'2025-12-31'")
    wide = reshape.pivot_sum(g, ["d"], "grp", ["CRZ", "MN_NORTH", "OUTER"], "n").dropna()
    return wide.select("d", F.col("CRZ").cast("double").alias("y"), F.ln(F.col("MN_NORTH").cast("double")).alias("ln_mn"), F.ln(F.col("OUTER").cast("double")).alias("ln_out"))


def features(t):
    return t._stored("forecast_days", lambda: timeops.calendar_features(daily_wide(t)).withColumn("ln_y", F.ln("y")))


_CAL = [*[f"dow{k}" for k in range(6)], "holiday", "hol_adj", "xmas", "sin1", "cos1"]
# The model variants that are compared, as blocks of features.
_BLOCKS = {"calendar": _CAL, "both groups": ["ln_mn", "ln_out"], "far group": ["ln_out"], "trend": ["trend"]}
_COMPARED = [
    ("ridge", ("calendar", "trend")),
    ("ridge", ("calendar", "both groups", "trend")),
    ("ridge", ("calendar", "both groups")),
    ("ridge", ("calendar", "far group")),
    ("gbt", ("calendar", "both groups")),
]
_NAMES = {"ridge": "ridge", "gbt": "boosted trees"}
_VARIANTS = {f"{_NAMES[kind]} {' + '.join(blocks)}": (kind, [x for b in blocks for x in _BLOCKS[b]]) for kind, blocks in _COMPARED}
_TRAIN_END = "2024-10-31"


@query("forecast_backtest")
def forecast_backtest(t):
    """Weekly naive, four ridge variants and boosted trees: accuracy before the policy, effect after it."""
    df = features(t)
    pre = F.col("d") < F.lit("2025-01-05").cast("date")
    train = F.col("d") <= F.lit(_TRAIN_END).cast("date")
    naive = timeops.lag_rows(df.withColumn("one", F.lit(1)), "y", ["one"], "d", 7, "p")
    out = forecast.metrics(naive.where(pre & ~train).withColumn("model", F.lit("naive t-7")), ["model"], "y", "p").withColumn("post_effect_pct", F.lit(None).cast("double"))
    for name, (kind, xs) in _VARIANTS.items():
        held = forecast.fit_predict(df, train, "ln_y", xs, kind, "p", SEED).where(pre & ~train)
        m = forecast.metrics(held.withColumns({"model": F.lit(name), "p": F.exp("p")}), ["model"], "y", "p")
        full = forecast.fit_predict(df, pre, "ln_y", xs, kind, "cf", SEED).where(~pre)
        effect = full.agg((100.0 * (F.exp(F.avg(F.col("ln_y") - F.col("cf"))) - 1.0)).alias("e")).scalar()
        out = out.unionByName(m.withColumn("post_effect_pct", effect))
    return out


_FC = {
    "fc_daily": """SELECT d, CAST(sum(n) FILTER (WHERE grp = 'CRZ') AS DOUBLE) AS y, sum(n) FILTER (WHERE grp = 'MN_NORTH') AS a, sum(n) FILTER (WHERE grp = 'OUTER') AS b
        FROM zone_day_pu JOIN dim_zone USING (zone) WHERE d BETWEEN DATE '2022-01-01' AND DATE '2025-12-31' GROUP BY d""",
    "fc_y": "SELECT d, y FROM fc_daily WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL",
    "fc_p": "SELECT d, y, lag(y, 7) OVER (ORDER BY d) AS p FROM fc_y",
    "fc_cf": "SELECT d, y, avg(ln(y)) FILTER (WHERE d < DATE '2025-01-05') OVER (PARTITION BY isodow(d)) AS cf FROM fc_y",
    "fc_res": "SELECT row_number() OVER (ORDER BY d) - 1 AS i, ln(y) - cf AS r FROM fc_cf WHERE d < DATE '2025-01-05'",
    "fc_gap": "SELECT strftime(d, '%Y-%m') AS month, count(*) AS days, avg(ln(y) - cf) AS gap FROM fc_cf WHERE d >= DATE '2025-01-05' GROUP BY 1",
    "fc_blk": f"""SELECT month, days, gap, draw, b, CAST(floor({u_sql(str(SEED), "month", "draw", "b")} * ((SELECT count(*) FROM fc_res) - 7)) AS BIGINT) AS start
        FROM fc_gap CROSS JOIN (SELECT unnest(range(1, 501)) AS draw) CROSS JOIN (SELECT unnest(range(0, 5)) AS b) WHERE b < ceil(days / 7.0)""",
    "fc_sim": """SELECT month, days, gap, draw, avg(r) AS sim FROM fc_blk CROSS JOIN (SELECT unnest(range(0, 7)) AS o) JOIN fc_res ON i = start + o WHERE b * 7 + o < days GROUP BY ALL""",
}


@query(
    "forecast_metrics",
    """SELECT CAST(count(*) AS BIGINT) AS holdout_days, 100.0e0 * avg(abs(y - p) / y) AS mape_pct, sqrt(avg((y - p) * (y - p))) AS rmse, 100.0e0 * avg((y - p) / y) AS bias_pct
       FROM fc_p WHERE p IS NOT NULL AND d > DATE '2024-10-31' AND d < DATE '2025-01-05'""",
    "mape_pct rmse bias_pct",
    _FC,
)
def forecast_metrics(t):
    """Accuracy of the weekly naive forecast on the holdout."""
    naive = timeops.lag_rows(daily_wide(t).withColumn("one", F.lit(1)), "y", ["one"], "d", 7, "p")
    return forecast.metrics(naive.where("d > DATE'2024-10-31' AND d < DATE'2025-01-05'"), [], "y", "p")


@query(
    "block_bootstrap_ci",
    """SELECT month, CAST(days AS BIGINT) AS days, 100.0e0 * (exp(gap) - 1) AS effect_pct, 100.0e0 * (exp(quantile_cont(gap - sim, 0.025)) - 1) AS ci_low,
         100.0e0 * (exp(quantile_cont(gap - sim, 0.975)) - 1) AS ci_high FROM fc_sim GROUP BY month, days, gap""",
    "effect_pct ci_low ci_high",
    _FC,
)
def block_bootstrap_ci(t):
    """Monthly effects against weekday means before the policy, with a 7-day block bootstrap."""
    df = daily_wide(t)
    pre = F.col("d") < F.lit("2025-01-05").cast("date")
    base = df.where(pre).groupBy(F.weekday("d").alias("wd")).agg(F.avg(F.ln("y")).alias("cf"))
    df = df.withColumn("wd", F.weekday("d")).join(base, "wd").withColumn("r", F.ln("y") - F.col("cf"))
    residuals = forecast.numbered(df.where(pre).select("d", "r"), "d").select("i", "r")
    gaps = df.where(~pre).groupBy(F.date_format("d", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("days"), F.avg("r").alias("gap"))
    return forecast.monthly_block_ci(residuals, gaps, 500, SEED)
