"""Batched models, the forest's tables, roll-ups, noise, progress logs, raw files and workers without the package."""

import datetime as dt
import os
import subprocess
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_estimators import SCHEMA, make_panel
from tripspark.functions.exprs import laplace_noise, uniform01
from tripspark.operators import fe_batch, fixed_effects, forest, longrun, privacy
from tripspark.plans import governance
from tripspark.session import scratch_path
from tripspark.sources import catalog
from tripspark.streaming import hourly

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


# ---- many fixed-effects models at once


def test_batch_equals_single_fits_with_gaps(spark):
    panel = spark.createDataFrame(make_panel(drop={(0, 1), (3, 4), (7, 7), (8, 2)}), SCHEMA)
    panel = panel.withColumns(
        {
            "tw": F.concat_ws("_", "treat", "woy"),
            "half": F.when((F.col("zone") + F.col("t")) % 5 != 0, F.col("y") * 2 + F.col("x")),  # an outcome with gaps of its own
            "part": F.when(F.col("zone") % 2 == 0, "even").otherwise("odd"),
        }
    )
    specs = [
        fe_batch.Spec("plain", ("tp",), ("zone", "t"), "zone"),
        fe_batch.Spec("two", ("tp", "x"), ("zone", "t"), "zone"),
        fe_batch.Spec("weighted", ("tp",), ("zone", "t"), "zone", "w_pre"),
        fe_batch.Spec("seasonal", ("tp", "x"), ("zone", "t", "tw"), "zone"),
    ]
    got = {(r.part, r.outcome, r.spec, r.term): r for r in fe_batch.fe_ols_batch(panel, ["y", "half"], specs, by=("part",)).collect()}
    assert len(got) == 2 * 2 * 6
    for part, y, s in (("odd", "half", specs[3]), ("even", "half", specs[2])):
        rows = panel.where(F.col("part") == part)
        fit = fixed_effects.fe_ols(rows, y, list(s.xs), list(s.fes), s.cluster, s.w)
        for want in fit.rows():
            r = got[part, y, s.name, want["term"]]
            assert (r.coef, r.se, r.n_obs, r.n_clusters) == (pytest.approx(want["coef"], abs=1e-8), pytest.approx(want["se"], rel=1e-6), want["n_obs"], want["n_clusters"])


def test_batch_without_rows_or_with_an_absorbed_regressor(spark):
    panel = spark.createDataFrame(make_panel(), SCHEMA)
    spec = [fe_batch.Spec("plain", ("treat", "tp"), ("zone", "t"), "zone")]
    rows = {r.term: r for r in fe_batch.fe_ols_batch(panel, ["y"], spec).collect()}
    assert rows["treat"].coef is None and rows["tp"].coef == pytest.approx(0.5, abs=0.2)
    assert fe_batch.fe_ols_batch(panel.limit(0), ["y"], spec).collect() == []
    only = fe_batch.fe_ols_batch(panel, ["y", "x"], spec, only=F.col("outcome") == "x").collect()
    assert {r.outcome for r in only} == {"x"}


# ---- the forest's flag


def trips(spark, n=600):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        miles, fare = float(rng.gamma(2, 3) + 0.1), float(rng.gamma(3, 6) + 1)
        day = dt.date(2024, 12, 1) + dt.timedelta(days=int(rng.integers(0, 70)))
        pay = None if i % 97 == 0 else fare * float(rng.uniform(0.3, 1.4))
        rows.append((f"HV000{i % 2}", i % 4, i % 3, i % 2, day, miles, float(rng.integers(100, 4000)), fare, pay, float(rng.uniform(0, 9)), float(i % 11), float(rng.uniform(1, 70)), int(rng.random() < 0.1)))
    names = "company_code string, pu int, dl int, touch_crz int, d date, miles double, time_s double, fare double, driver_pay double, tips double, wait_min double, mph double, iso_flag int"
    return spark.createDataFrame(rows, names)


def test_forest_tables_equal_sql_given_the_flag(spark):
    scores = trips(spark)
    con = duckdb.connect()
    con.register("s", scores.toPandas())
    got = {r.rule: (r.n, r.pct, r.overlap_iso_pct) for r in governance.rule_overlap(scores).collect()}
    for rule, cond in {**governance._RULES, "forest": "iso_flag = 1"}.items():
        n, pct, both = con.sql(f"SELECT count(*) FILTER (WHERE {cond}), 100.0 * count(*) FILTER (WHERE {cond}) / count(*), 100.0 * count(*) FILTER (WHERE ({cond}) AND iso_flag = 1) / greatest(count(*) FILTER (WHERE {cond}), 1) FROM s").fetchall()[0]
        assert got[rule] == (n, pytest.approx(pct), pytest.approx(both))
    made = {"fare_pm": "fare / miles", "pay_ratio": "driver_pay / fare", "tip_ratio": "tips / fare"}
    for r in governance.flag_profile(scores).collect():
        want = con.sql(f"SELECT median({made.get(r.measure, r.measure)}) FILTER (WHERE iso_flag = 0), median({made.get(r.measure, r.measure)}) FILTER (WHERE iso_flag = 1) FROM s").fetchall()[0]
        assert (r.normal, r.anomalous) == (pytest.approx(want[0]), pytest.approx(want[1]))
    rates = {(r.company_code, r.crz, r.post): (r.n, r.flagged_pct) for r in governance.flag_rates(scores).collect()}
    want = con.sql("SELECT company_code, NULL, NULL, count(*), 100 * avg(iso_flag) FROM s GROUP BY 1 UNION ALL SELECT NULL, touch_crz, (d >= DATE '2025-01-05')::INT, count(*), 100 * avg(iso_flag) FROM s GROUP BY 2, 3").fetchall()
    assert rates == {tuple(w[:3]): (w[3], pytest.approx(w[4])) for w in want}


def test_missing_features_become_medians(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, None, 6.0), (3, 3.0, float("inf")), (4, 8.0, float("nan")), (5, 2.0, 7.0)], "id int, a double, b double")
    got = {r.id: (r.a, r.b) for r in forest.filled(df, ["a", "b"]).collect()}
    assert got == {1: (1.0, 5.0), 2: (2.5, 6.0), 3: (3.0, 6.0), 4: (8.0, 6.0), 5: (2.0, 7.0)}


# ---- privacy


def test_roll_up_of_sets_equals_one_count_each(spark):
    rng = np.random.default_rng(5)
    rows = [(int(a), int(b), None if c == 0 else int(c)) for a, b, c in zip(rng.integers(0, 9, 400), rng.integers(0, 4, 400), rng.integers(0, 30, 400), strict=True)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    sets = {"a": ["a"], "a, b": ["a", "b"], "all": ["a", "b", "c", "half"]}
    derived = lambda cells: cells.withColumn("half", F.floor(F.col("a") / 2))
    got = {r.qi: r.asDict() for r in privacy.k_anonymity_sets(df, sets, ["a", "b", "c"], derived).collect()}
    for label, columns in sets.items():
        assert got[label] == privacy.k_anonymity(derived(df), columns, label).first().asDict()


def test_sums_of_noisy_cells(spark):
    rows = spark.createDataFrame([(1, [(1, 5.0), (2, 0.0)]), (2, [(1, 3.0)])], "zone int, days array<struct<d: int, n: double>>")
    got = {(r.zone, r.eps, r.rep): r.n for r in privacy.laplace_sums(rows, ["zone"], "days", ["d"], "n", (0.5, 2.0), 3, 11).collect()}
    cells = rows.select("zone", F.inline("days")).select("*", F.explode(F.array(F.lit(0.5), F.lit(2.0))).alias("eps")).select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rep"))
    u = uniform01(F.lit(11), F.col("eps").cast("decimal(10,4)"), "rep", "zone", "d")
    noisy = cells.withColumn("n", F.greatest(F.col("n") + laplace_noise(u, 1.0 / F.col("eps")), F.lit(1.0)))
    want = {(r.zone, r.eps, r.rep): r.s for r in noisy.groupBy("zone", "eps", "rep").agg(F.sum("n").alias("s")).collect()}
    assert len(got) == 12 and got == {k: pytest.approx(v) for k, v in want.items()}


# ---- bounds


def test_bias_weights_are_cumulated_sums():
    months = longrun.months_between(2022, 2025)
    change, curve = longrun.bias_weights(months, longrun.SPECS["S2"])
    k = np.arange(1, 11)
    assert (change, curve) == (pytest.approx(k.mean()), pytest.approx((k * (k + 1) / 2).mean()))


# ---- streams and files


def test_progress_log_outlives_the_history(spark):
    land, sink, check, log = (scratch_path(spark, n) for n in ("land", "sink", "check", "log"))
    t0 = dt.datetime(2024, 1, 1)
    for i in range(9):
        rows = [(t0 + dt.timedelta(hours=i), "a")] * (i + 1)
        spark.createDataFrame(rows, "ts timestamp_ntz, k string").coalesce(1).write.mode("append").parquet(land)
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        events = hourly.read_stream(spark, land, spark.read.parquet(land).schema, 1)
        hourly.run_logged(hourly.hourly(events, "ts", ["k"], [F.count(F.lit(1)).alias("n")]), sink, check, log, flush=4)
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
    told = hourly.read_progress(spark, log)
    assert told.agg(F.sum("input_rows")).first()[0] == 45 and told.where("input_rows > 0").count() == 9
    assert told.select("batch").distinct().count() == told.count()


def test_columns_come_from_each_footer(spark):
    path = scratch_path(spark, "footers")
    spark.range(5).select(F.col("id").cast("int").alias("a")).coalesce(1).write.parquet(f"{path}/month=2024-01")
    spark.range(7).select("id", F.col("id").alias("a")).coalesce(1).write.parquet(f"{path}/month=2024-02")
    rows = catalog.footer_columns(catalog.list_files(spark, path)).collect()
    assert {(r.path.split("month=")[1][:7], r.n_rows, r.pos, r.name, r.type) for r in rows} == {
        ("2024-01", 5, 0, "a", "int32"), ("2024-02", 7, 0, "id", "int64"), ("2024-02", 7, 1, "a", "int64"),
    }


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from tripspark.plans.catalog import QUERIES
from tripspark.session import local_session

spark = local_session("2", 2, "without-package")
for name in ("file_catalog", "rowgroup_stats", "sha256_manifest", "isolation_forest"):
    print(name, QUERIES[name](spark, {data!r}).count() > 0)
"""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not mounted")
def test_workers_need_no_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = SCRIPT.format(root=ROOT, data="/root/testdata/sf0.001")
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600, check=False)
    assert got.returncode == 0, got.stderr[-3000:]
    assert got.stdout.count("True") == 4
