"""Expressions, kernels, sources and plans against NumPy and against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibrant.functions import scores as sc
from calibrant.functions import stats as st
from calibrant.operators import calibrate as cp
from calibrant.operators import folds as fd
from calibrant.operators import joint as jp
from calibrant.operators import kernels as kn
from calibrant.operators import metrics as mt
from calibrant.operators.scales import scored
from calibrant.plans import evaluate as ev
from calibrant.sources import datasets as dt
from calibrant.sources import panels as ps
from calibrant.sources import store

SF = "/root/testdata/sf0.001"
GRID = "named_struct('q10',7D,'q20',8D,'q30',9D,'q40',9.5D,'q50',10D,'q60',10.5D,'q70',11D,'q80',12D,'q90',13D)"
CROSSED = "named_struct('q10',12D,'q20',8D,'q30',10D,'q40',9.5D,'q50',8D,'q60',10.5D,'q70',11D,'q80',9D,'q90',9D)"


def quantile(xs, alpha):
    xs = sorted(xs)
    n = len(xs)
    return xs[int(np.ceil(min(np.ceil((n + 1) * (1 - alpha)) / n, 1) * (n - 1)))] if n else np.inf


def test_conformal_quantile(spark):
    rows = [(list(map(float, range(1, 11))),), ([3.0],), ([],), ([1.0, 2.0, 2.0, 9.0],)]
    got = spark.createDataFrame(rows, "xs array<double>").select(st.conformal_quantile(F.col("xs"), 0.1)).collect()
    assert [r[0] for r in got] == [10.0, 3.0, np.inf, quantile([1, 2, 2, 9], 0.1)]


@pytest.mark.parametrize("grid", [GRID, CROSSED])
@pytest.mark.parametrize("name", [n for n in sc.SCORES if n not in ("joint", "signed")])
def test_a_score_is_within_the_threshold_where_the_interval_holds(spark, name, grid):
    s = sc.Score(name, 0.2)
    df = spark.range(51).selectExpr("id * 0.4D + 0.5D AS y", "10D AS yhat", f"{grid} AS q", "4D AS iqr_floor", "2D AS rho_mad", "1.5D AS sigma_lo", "0.5D AS sigma_hi", "1D AS prev")
    for q in (0.05, 0.5, 1.5):
        lo, hi = s.bounds(F.lit(q), F.lit(q))
        rows = df.select(s.score().alias("s"), lo.alias("lo"), hi.alias("hi"), "y").collect()
        for r in rows:
            if min(abs(r["y"] - r["lo"]), abs(r["y"] - r["hi"])) > 1e-9 and not (name == "cdf_tail" and (r["s"] in (0.1,) or q >= 0.1)):
                assert (r["s"] <= q) == (r["lo"] <= r["y"] <= r["hi"]), (name, q, r)


def test_names_and_guards():
    assert sc.resolve("residual") == "abs" and sc.slug("cdf_tail") == "cdf-tail"
    assert sc.interval_fields(0.2) == ("q10", "q90") and sc.interval_fields(0.4) == ("q20", "q80") and sc.interval_fields(0.07) == ("q10", "q90")
    for bad in (lambda: ev.EvalConfig(alpha=1.5), lambda: ev.EvalConfig(score="odd"), lambda: ev.EvalConfig(methods=("No",)), lambda: ev.EvalConfig(score="cdf_tail", asymmetric=True)):
        with pytest.raises(ValueError):
            bad()
    assert ev.EvalConfig(score="signed").asymmetric
    assert ev.classify(("SplitCP", "NormMaxCP")) == (["SplitCP"], ["NormMaxCP"])
    assert ev.EvalConfig(cal_windows=5, min_cal_windows=3).active_cal_windows(4) == 4 and ev.EvalConfig(min_cal_windows=3).active_cal_windows(2) is None


def series(seed=0, n=60, gaps=()):
    x = np.abs(np.random.default_rng(seed).normal(size=n))
    return [(k, "cal" if k < 20 else "test", None if k in gaps else float(v)) for k, v in enumerate(x)]


def frame(spark, gaps=()):
    rows = [(f"k{s}", *r) for s in range(2) for r in series(s, gaps=gaps)]
    return spark.createDataFrame(rows, "key string, w int, split string, s double")


def aci_by_numpy(rows, alpha, gamma, size):
    buf, a, out = [r[2] for r in rows if r[1] == "cal" and r[2] is not None][-size:], alpha, {}
    for w, split, s in rows:
        if split == "test":
            out[w] = kn.order_quantile(np.array(buf), a)
            if s is not None:
                a = min(max(a + gamma * (alpha - float(s > out[w])), 0), 1)
                buf = [*buf, s][-size:]
    return out


@pytest.mark.parametrize("gaps", [(), (5, 25, 26, 40)])
def test_aci_fold_is_the_loop(spark, gaps):
    got = cp.aci(frame(spark, gaps), ["key"], 0.2, 0.05, 15).collect()
    for s in range(2):
        expected = aci_by_numpy(series(s, gaps=gaps), 0.2, 0.05, 15)
        assert {r["w"]: r["thr"] for r in got if r["key"] == f"k{s}"} == pytest.approx(expected)


def test_frames_leave_out_missing_scores(spark):
    gaps = (21, 22, 30)
    got = {(r["key"], r["w"]): r["thr"] for r in cp.trailing(frame(spark, gaps), ["key"], 0.2, 10).collect()}
    rows = series(0, gaps=gaps)
    for w in (21, 23, 31, 45):
        past = [r[2] for r in rows if r[0] < w and r[2] is not None][-10:]
        assert got["k0", w] == sorted(past)[int(np.ceil(0.8 * 9))]


def test_without_learning_aci_is_the_corrected_trailing_quantile(spark):
    df = frame(spark)
    a = {(r["key"], r["w"]): r["thr"] for r in cp.aci(df, ["key"], 0.2, 0.0, 10).collect()}
    b = {(r["key"], r["w"]): r["thr"] for r in cp.trailing(df, ["key"], 0.2, 10, correction=True).collect()}
    assert a == b


def test_kernels_cover_and_are_deterministic():
    x = np.abs(np.random.default_rng(42).normal(size=1000))
    for f in (kn.agaci, kn.dtaci):
        thr = f(x[:200], x[200:], 0.1)
        assert abs((x[200:] <= thr).mean() - 0.9) < 0.07
        assert (f(x[:200], x[200:], 0.1) == thr).all()
        assert np.isfinite(f(x[:200], np.array([np.nan, 1.0]), 0.1)).all() and len(f(np.array([]), x[:3], 0.1)) == 3
    e = np.random.default_rng(7).normal(size=400)
    lo, up = kn.spci(e[:100], e[100:], 0.2, w=20, bins=3, retrain=25)
    assert 0.65 < ((e[100:] >= lo) & (e[100:] <= up)).mean() < 0.95
    m = np.random.default_rng(1).normal(size=(120, 3))
    lo, up = kn.acmcp(m[:60], m[60:], 0.2, 2)
    assert ((m[60:, 2] >= -lo) & (m[60:, 2] <= up)).mean() > 0.6 and (lo >= 0).all()


def test_kernel_plans_are_the_kernels(spark):
    got = kn.online(frame(spark), ["key"], 0.2, ("AgACI",), size=15).collect()
    rows = series(0)
    cal, test = (np.array([r[2] for r in rows if r[1] == k]) for k in ("cal", "test"))
    mine = [r["thr"] for r in sorted((r for r in got if r["key"] == "k0"), key=lambda r: r["w"])]
    assert mine == pytest.approx(kn.agaci(cal, test, 0.2, size=15).tolist())


def test_cafht_by_numpy(spark):
    panel = ps.user_panel(spark, SF)
    p = panel.withColumn("r", F.abs(F.col("y") - F.col("yhat"))).toPandas()
    alpha, q0, cal = 0.2, 0.1, ps.USER["cal"]

    def path(r, g):
        a, out = alpha, []
        for h, s in enumerate(r):
            q = q0 if h < np.ceil(1 / max(a, 1e-9)) else sorted(r[:h])[min(max(int(np.ceil(h * (1 - a))) - 1, 0), h - 1)]
            out.append(q)
            a = min(max(a + g * (alpha - float(s > q)), 0), 1)
        return np.array(out)

    traj = {k: g.sort_values("h")["r"].to_numpy() for k, g in p.groupby(["series", "w"])}
    excess = lambda r, q: (np.maximum(r - q, 0) / np.maximum(q, 1e-8)).max()
    best = []
    for g in jp.GAMMAS:
        one = [(r, path(r, g)) for (s, w), r in traj.items() if w < max(1, int(0.5 * cal))]
        best.append((round((1 + quantile([excess(*x) for x in one], alpha)) * 2 * np.mean([x[1] for x in one]), 9), g))
    g = min(best)[1]
    eps = quantile([excess(r, path(r, g)) for (s, w), r in traj.items() if int(0.5 * cal) <= w < cal], alpha)
    for r in jp.cafht(panel, alpha, cal).collect():
        assert r["gamma"] == g and r["eps"] == pytest.approx(eps)
        assert r["radii"] == pytest.approx(((1 + eps) * path(traj[r["series"], r["w"]], g)).tolist())


def test_rank_invariance(spark):
    """squared is a monotone function of abs, so both calibrate to the same intervals."""
    panel = ps.user_panel(spark, SF)
    ivs = []
    for name in ("abs", "squared"):
        lo, hi = sc.Score(name, 0.2).bounds("thr", "thr")
        ivs.append({(r["series"], r["w"], r["h"]): (r["lo"], r["hi"]) for r in cp.split_cp(scored(panel, name, 0.2, ["series"]), ["series", "h"], 0.2).select("series", "w", "h", lo.alias("lo"), hi.alias("hi")).collect()})
    assert ivs[0].keys() == ivs[1].keys()
    assert all(ivs[0][k] == pytest.approx(ivs[1][k]) for k in ivs[0])


def test_metrics_masks(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", 0, 0, 1.0, 0.0, 2.0), ("a", 1, 0, 3.0, 0.0, 2.0), ("a", 2, 0, None, 0.0, 2.0), ("a", 3, 0, 1.0, -inf, inf), ("a", 4, 0, nan, 0.0, 2.0)]
    m = mt.marks(spark.createDataFrame(rows, "series string, w int, h int, y double, lo double, hi double"), 0.2)
    r = mt.by_horizon(m).first()
    assert (r["coverage"], r["avg_width"], r["winkler_score"], r["frac_infinite"]) == pytest.approx((0.5, 2.0, (2 + 2 + 10) / 2, 0.2))
    assert mt.joint_coverage(m).first()[0] == 0.2


def test_folds(spark):
    assert fd.fold_count(5, 12, 100) == 5 and fd.fold_count(100, 2, 10) >= 2
    order = np.arange(11)
    np.random.RandomState(42).shuffle(order)
    names = spark.range(2000).selectExpr("cast(id AS string) AS series")
    got = names.groupBy(fd.hash_fold(F.col("series"), 4).alias("f")).count().collect()
    assert {r["f"] for r in got} == {0, 1, 2, 3} and all(400 < r["count"] < 600 for r in got)
    first = {r["series"]: r["f"] for r in names.select("series", fd.hash_fold(F.col("series"), 4).alias("f")).collect()}
    again = {r["series"]: r["f"] for r in names.limit(100).select("series", fd.hash_fold(F.col("series"), 4).alias("f")).collect()}
    assert all(first[k] == f for k, f in again.items())  # a fold depends on the name alone


def test_datasets(spark):
    rows = [(f"s{i}", "2024-01-01 00:00:00", "H", [float(j + 100 * i) for j in range(100)], [[1.0, 2.0], [3.0, 4.0]]) for i in range(3)]
    raw = spark.createDataFrame(rows, "item_id string, start string, freq string, target array<double>, feat array<array<double>>").withColumn("start", F.to_timestamp("start"))
    assert dt.is_gift_eval(raw) and not dt.is_fev(raw)
    fev = dt.to_fev(raw, "H")
    one = fev.where("id = 's1'").first()
    assert dt.is_fev(fev) and len(one["timestamp"]) == 100 and (one["timestamp"][1] - one["timestamp"][0]).seconds == 3600 and one["feat"] == [[1.0, 3.0], [2.0, 4.0]]
    assert dt.to_fev(fev, "H") is fev
    with pytest.raises(ValueError):
        dt.to_fev(raw.drop("start"), "H")
    s = dt.statistics(raw, 10).first()
    assert (s["series"], s["min_length"], s["sum_length"], s["windows"]) == (3, 100, 300, 1)
    train, val, test = dt.splits(raw, 10, 2)
    assert train.select(F.size("target")).first()[0] == 70 and val.select(F.size("target")).first()[0] == 80
    assert [len(r["input"]) for r in test.where("item_id = 's0'").orderBy("w").collect()] == [80, 90]
    nested = raw.select("item_id", "start", "freq", F.array("target", "target").alias("target"))
    assert dt.is_multivariate(nested) and dt.univariate(nested).count() == 6
    assert dt.to_fev(nested, "H", variates=["a", "b"]).columns == ["id", "timestamp", "a", "b"]
    assert (dt.seasonality("15T"), dt.seasonality("H"), dt.seasonality("W-SUN"), dt.horizon("D", "medium")) == (96, 24, 1, 300)
    assert dt.calibration_windows(1000, 10, 5, -1) == 94 and dt.calibration_windows(100, 10, 5, -1) == 0
    assert dt.meta(dt.with_meta(raw, freq="H"))["freq"] == "H" and dt.meta(raw) == {}
    assert [t["horizon"] for t in dt.tasks({"datasets": [{"name": "x/H", "terms": ["short", "long"]}]})] == [48, 720]
    got = spark.createDataFrame([([None, 1.0, None, 3.0, None],), ([None],)], "x array<double>").select(dt.filled(F.col("x")), dt.truncate(F.col("x"), 2)).collect()
    assert got[0][0] == [1, 1, 1, 3, 3] and got[0][1] == [3.0, None] and got[1][0] == [0.0]
    assert dt.load(spark, "/nowhere", "x") is None


def test_stores(spark, tmp_path):
    panel = ps.user_panel(spark, SF).withColumn("task", F.lit("t")).withColumn("model", F.lit("m"))
    store.write_panel(panel, f"{tmp_path}/panel")
    back = store.read_panel(spark, f"{tmp_path}/panel")
    assert back.count() == panel.count() and [r["w"] for r in store.discover_windows(back).collect()][:3] == [0, 1, 2]
    plan = back.select("q.q10")._jdf.queryExecution().executedPlan().toString()
    assert "q90" not in plan
    store.write_metadata(spark, f"{tmp_path}/meta/a", task_name="t", test_windows=3)
    store.write_metadata(spark, f"{tmp_path}/meta/b", task_name="u", test_windows=0)
    assert [r["task_name"] for r in store.read_metadata(spark, f"{tmp_path}/meta").collect()] == ["t"]
    name = store.result_name("cp_results", 0.1, "cdf_tail", None, "marginal", asymmetric=True)
    assert store.result_parameters(name) == {"kind": "cp_results", "alpha": 0.1, "score": "cdf_tail", "cal_windows": -1, "mode": "marginal", "asymmetric": True, "online": False}
    store.write_csv(spark.createDataFrame([("A", float("nan"), 1.0)], "method string, coverage double, avg_width double"), str(tmp_path), name)
    r = store.read_results(spark, str(tmp_path), "method string, coverage double, avg_width double").first()
    assert (r["method"], r["coverage"], r["avg_width"], r["alpha"], r["score"]) == ("A", None, 1.0, 0.1, "cdf_tail")
    pred = spark.createDataFrame([("s", 1, [1.0, 2.0], [0.0, 1.0])], "item_id string, w int, predictions array<double>, `0.1` array<double>")
    true = spark.createDataFrame([("s", 1, [5.0, 6.0])], "item_id string, w int, target array<double>")
    rows = store.import_windows(pred, true, "t", "m", 1).orderBy("h").collect()
    assert [(r["y"], r["yhat"], r["q"]["q10"], r["q"]["q90"], r["split"]) for r in rows] == [(5.0, 1.0, 0.0, None, "test"), (6.0, 2.0, 1.0, None, "test")]


@pytest.mark.parametrize("config", [{}, {"score": "cqr", "asymmetric": True}, {"score": "cdf_tail"}, {"score": "scaled_cqr"}, {"score": "diff"}, {"score": "log"}, {"score": "signed"}])
def test_run(spark, config):
    rows = ev.run(ps.user_panel(spark, SF), ev.EvalConfig(window=20, **config)).collect()
    assert {r["method"] for r in rows} == {"Native", "SplitCP", "TrailingWindow", "WeightedCP", "ACI", "PID"}
    # Two tails at half the level: with few scores the weighted threshold is infinite, and nothing counts.
    some = [r for r in rows if r["method"] != "WeightedCP"]
    assert all(0 <= r["coverage"] <= 1 and r["avg_width"] > 0 for r in some)
    assert next(r for r in rows if r["method"] == "Native")["scaled_width"] == 1


def test_filters(spark):
    from calibrant.operators import reports as rp

    rows = spark.createDataFrame([("t1", "m", "SplitCP", 0.8), ("t2", "m", "ACI", 0.9), ("split", None, "ACI", 0.7)], "task string, model string, method string, coverage double")
    names = lambda df: sorted(r["task"] for r in df.collect())
    assert names(rp.filtered(rows, "SPLIT", ("task", "model", "method"))) == ["split", "t1"]
    assert names(rp.filtered(rows, coverage__ge=0.8, coverage__le=0.85)) == ["t1"]
    assert names(rp.filtered(rows, method="ACI", task=("t2", "t3"))) == ["t2"]
    tidy = rp.tidy(rows.withColumn("runtime", F.lit(1.0)).withColumn("z", F.lit(0.0625)), {"alpha": 0.2}, drop=("model",))
    assert tidy.columns == ["task", "method", "coverage", "z", "alpha", "runtime"] and tidy.first()["z"] == 0.062


@pytest.mark.parametrize("condition", ["model = 'mean'", "method = 'SplitCP'", "task = 't1'", "model = 'mean' AND method = 'Native'"])
def test_filters_right_on_results(spark, condition):
    from calibrant.plans import catalog

    rows = catalog.results(spark, SF)
    every = [r.asDict() for r in rows.collect()]
    wanted = {c.split(" = ")[0]: c.split("'")[1] for c in condition.split(" AND ")}
    kept = [(r["task"], r["model"], r["method"]) for r in every if all(r[k] == v for k, v in wanted.items())]
    assert kept and sorted((r["task"], r["model"], r["method"]) for r in rows.where(condition).collect()) == sorted(kept)


@pytest.mark.parametrize("n", [1, 2, 7, 300, 5000])
def test_order_statistics_by_numpy(spark, n):
    """Exact at any size, with hot values, several groups and nulls."""
    from calibrant.operators.pooled import medians, order_statistics

    rng = np.random.default_rng(n)
    groups = {"a": np.round(np.exp(rng.normal(size=n)), 2), "hot": np.where(rng.random(n) < 0.6, 3.0, rng.normal(size=n)), "same": np.full(n, 1.5)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("none", None)], "g string, v double")
    ranks = {"low": lambda c: F.lit(1), "high": lambda c: c, "past": lambda c: c + 5, "mid": lambda c: F.ceil(c * 0.8)}
    got = {r["g"]: r for r in order_statistics(df, ["g"], "v", ranks).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        s = np.sort(vs)
        assert (got[g]["n"], got[g]["low"], got[g]["high"], got[g]["past"], got[g]["mid"]) == (n, s[0], s[-1], s[-1], s[int(np.ceil(n * 0.8)) - 1])
    mid = {r["g"]: r["m"] for r in medians(df, ["g"], {"m": F.col("v")}).collect()}
    assert all(mid[g] == pytest.approx(np.median(vs)) for g, vs in groups.items())
    assert order_statistics(df.where("g = 'a'"), [], "v", {"x": lambda c: F.lit(1)}).first()["x"] == groups["a"].min()


def test_vectors_of_the_conformal_quantile(spark):
    q = lambda xs, **o: spark.range(1).select(st.conformal_quantile(F.array_sort(F.array(*[F.lit(float(x)) for x in xs]).cast("array<double>")), 0.1, **o)).first()[0]
    assert (q(range(1, 11)), q([3.0]), q([])) == (10.0, 3.0, float("inf"))
    assert q(range(1, 6), correction=False) == 5.0 and q(range(1, 6), correction=False, min_guard=True) == float("inf")


def test_acmcp_error_forecast_by_hand():
    recent = np.array([1.0, 2.0, 4.0, 3.0, 5.0])
    assert kn.error_forecast(recent, np.zeros((5, 0))) == 3.0 and kn.error_forecast(np.array([]), np.zeros((0, 2))) == 0.0
    shorter = np.array([[0.5], [1.0], [2.0], [1.5], [2.5]])  # the step's errors are twice these
    a = np.polyfit(recent[:-1], recent[1:], 1)
    assert kn.error_forecast(recent, shorter) == pytest.approx(((a[0] * 5.0 + a[1]) + 5.0) / 2)
    assert kn.error_forecast(recent[:2], shorter[:2]) == 1.5  # too few rows: means


def test_spci_keeps_its_bounds_between_fits():
    e = np.random.default_rng(0).normal(size=60)
    lo, up = kn.spci(e[:10], e[10:], 0.2, w=100, retrain=10)
    assert (lo[0], up[0]) == tuple(np.percentile(e[:10], [10, 90])) and len(set(lo[:10])) == 1 and lo[10] == np.percentile(e[:20], 10)
    assert tuple(x[0] for x in kn.spci(np.array([]), e[:1], 0.2)) == (0.0, 0.0)
    lo, up = kn.spci(e[:21], e[21:22], 0.2, w=20, bins=5)  # one row to fit on: every quantile is its target
    assert (lo[0], up[0]) == (e[20], e[20])


def test_a_method_of_ones_own(spark):
    def widest(rows, keys, alpha, s="s", order="w", **_):
        return cp.trailing(rows, keys, 0.0, None, s, order)

    ev.register_calibrator("Widest", widest)
    ev.register_joint("Constant", lambda panel, alpha, **_: panel.select("h").distinct().withColumn("radius", F.lit(1e6)))
    try:
        panel = ps.user_panel(spark, SF)
        got = {r["method"]: r for r in ev.run_timed(panel, ev.EvalConfig(methods=("Widest", "TrailingWindow"))).collect()}
        assert got["Widest"]["coverage"] > got["TrailingWindow"]["coverage"] and all(r["runtime"] > 0 for r in got.values()) and set(got) == {"Native", "Widest", "TrailingWindow"}
        assert ev.run_joint(panel, ev.EvalConfig(methods=("Constant",))).first()["joint_coverage"] == 1.0
        assert "Widest" in ev.online_methods() and "SplitCP" not in ev.online_methods()
    finally:
        del ev.MARGINAL["Widest"], ev.JOINT["Constant"]


def test_weights_of_ones_own(spark):
    x = spark.range(1).select(F.array(*[F.lit(float(v)) for v in (5, 1, 3)]).alias("v"))
    q = lambda target, w: x.select(st.weighted_quantile(F.col("v"), target, 0.9, 0.0, w)).first()[0]
    assert q(0.5, (1.0, 0.0, 0.0)) == 5.0 and q(0.5, (0.0, 1.0)) == 3.0 and q(0.5, (1.0, 1.0, 1.0)) == 3.0
