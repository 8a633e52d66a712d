"""Copula calibration against a plain fit over arrays."""

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from calibrant.operators import copula as cl
from calibrant.operators import joint as jp
from calibrant.plans import catalog
from calibrant.plans import evaluate as ev
from calibrant.sources import panels as ps


def plain(scores: np.ndarray, alpha: float, epochs: int, lr: float, cal_split: float = 0.6) -> np.ndarray:
    """Radii from trajectories' errors (rows, in order)."""
    first = int(np.floor(cal_split * len(scores)))
    base, rest = np.sort(scores[:first], axis=0), scores[first:]
    u = np.column_stack([(base[:, j][None, :] <= rest[:, j][:, None]).mean(axis=1) for j in range(scores.shape[1])])
    logit = np.full(scores.shape[1], min(max(1 - alpha, 0.01), 0.99))
    m = v = np.zeros_like(logit)
    for k in range(1, epochs + 1):
        theta = 1 / (1 + np.exp(-logit))
        s = 1 / (1 + np.exp(-20 * (theta - u)))
        p = s.prod(axis=1)
        g = np.sign(p.mean() - (1 - alpha)) * (p[:, None] * 20 * (1 - s)).mean(axis=0) * theta * (1 - theta)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        logit = np.clip(logit - lr * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8), -6, 6)
    return np.array([np.quantile(base[:, j], t) for j, t in enumerate(1 / (1 + np.exp(-logit)))])


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(2)
    return {g: np.round(np.abs(rng.normal(size=(n, 4))) * [1, 2, 3, 4], 2) for g, n in (("a", 120), ("b", 75))}


@pytest.fixture(scope="module")
def panel(spark, scores):
    """Trajectory k is window k // 5 of series k % 5: in order of both, as the rows are."""
    rows = [(g, f"s{k % 5}", k // 5, h, float(x), 0.0, "cal") for g, m in scores.items() for k, r in enumerate(m) for h, x in enumerate(r)]
    return spark.createDataFrame(rows, "task string, series string, w int, h int, y double, yhat double, split string")


def test_fit_of_groups_equals_the_plain_fit(panel, scores):
    got = {(r["task"], r["h"]): r["radius"] for r in cl.adam_radii(panel, 0.2, ("task",), epochs=40, lr=0.05).collect()}
    for g, m in scores.items():
        assert [got[g, h] for h in range(4)] == pytest.approx(plain(m, 0.2, 40, 0.05).tolist(), abs=1e-6)


def test_fit_without_groups_and_its_coverage(spark, panel, scores):
    one = panel.where("task = 'a'")
    got = [r["radius"] for r in cl.adam_radii(one, 0.2, epochs=80, lr=0.05).orderBy("h").collect()]
    assert got == pytest.approx(plain(scores["a"], 0.2, 80, 0.05).tolist(), abs=1e-6)
    fresh = np.abs(np.random.default_rng(5).normal(size=(4000, 4))) * [1, 2, 3, 4]
    assert 0.6 < (fresh <= got).all(axis=1).mean() < 0.95


def test_bisection_of_groups(panel):
    """Each group's radii are those that it has alone."""
    both = {(r["task"], r["h"]): r["radius"] for r in jp.copula_bisection(panel, 0.2, by=("task",)).collect()}
    for g in ("a", "b"):
        assert {h: r for (t, h), r in both.items() if t == g} == {r["h"]: r["radius"] for r in jp.copula_bisection(panel.where(F.col("task") == g), 0.2).collect()}


def test_no_rows(panel):
    none = panel.where("false")
    assert cl.adam_radii(none, 0.2, epochs=2).count() == 0 and jp.copula_bisection(none, 0.2).count() == 0


def test_a_step_that_a_trajectory_lacks_is_covered(spark):
    """A group of three steps beside one of four has the probabilities that it has alone."""
    rng = np.random.default_rng(3)
    rows = [(g, *map(float, rng.random(3)), float(rng.random()) if g == "a" else None) for g in ("a", "b") for _ in range(30)]
    vectors = spark.createDataFrame(rows, "task string, u0 double, u1 double, u2 double, u3 double")
    both = cl.fit(vectors, ["task"], 4, 0.2, 5, 0.05)
    alone = cl.fit(vectors.where("task = 'b'").drop("task", "u3"), [], 3, 0.2, 5, 0.05)
    assert both["b",][:3].tolist() == pytest.approx(alone[()].tolist())


def test_run_joint_all_fits_through_all_epochs(spark, monkeypatch):
    monkeypatch.setattr(ev, "JOINT", {"CopulaCPTS_Adam": ev.JOINT["CopulaCPTS_Adam"]})
    got = catalog.QUERIES["run_joint_all"](spark, SF).first()
    errors = {s: {} for s in ("cal", "test")}
    for r in ps.user_panel(spark, SF).select("split", "w", "series", "h", F.abs(F.col("y") - F.col("yhat")).alias("r")).collect():
        errors[r["split"]].setdefault((r["w"], r["series"]), {})[r["h"]] = r["r"]
    cal, test = (np.array([[t[h] for h in range(4)] for _, t in sorted(errors[s].items())]) for s in ("cal", "test"))
    series = np.array([s for _, s in sorted(errors["test"])])
    radii = plain(cal, catalog.ALPHA, 500, 0.01)
    assert got["avg_width"] == pytest.approx(2 * radii.mean(), abs=1e-5)
    assert got["coverage"] == pytest.approx(np.mean([(test[series == s] <= radii).mean() for s in set(series)]), abs=1e-5)
    assert got["joint_coverage"] == pytest.approx((test <= radii).all(axis=1).mean(), abs=1e-5)
