"""Sweeps against runs of each combination."""

import pytest
from oracle import SF
from pyspark.sql import functions as F

from calibrant.plans import evaluate as ev
from calibrant.sources import panels as ps


@pytest.fixture(scope="module")
def panel(spark):
    task = F.when(F.col("series").cast("int") % 2 == 0, "even").otherwise("odd")
    return ps.user_panel(spark, SF).withColumn("task", task)


def test_each_combination_equals_its_run(panel):
    methods, scores, alphas = ("SplitCP", "CFRNN", "WeightedCP"), ("mad_scaled", "diff", "residual"), (0.2, 0.3)
    sweep = lambda scores, cal: ev.run_sweep(panel, alphas, scores, ev.EvalConfig(methods=methods, options={"WeightedCP": {"decay": 0.9}}), ("task", "series"), (20,), cal).collect()
    swept = [*sweep(scores, (-1,)), *sweep(scores[1:], (3,))]
    assert len(swept) == 2 * 2 * (3 + 2) * 4
    for alpha, score, cal in ((0.2, "mad_scaled", -1), (0.3, "diff", 3), (0.3, "abs", -1)):
        config = ev.EvalConfig(alpha=alpha, score=score, methods=methods, window=20, cal_windows=cal, options={"WeightedCP": {"decay": 0.9}})
        alone = {(r["task"], r["method"]): r for r in ev.run(panel, config, ("task", "series")).collect()}
        mine = {(r["task"], r["method"]): r for r in swept if (r["alpha"], r["score"], r["cal_windows"]) == (alpha, score, cal)}
        assert set(mine) == set(alone)
        for k, r in alone.items():
            assert all(mine[k][c] == pytest.approx(v) for c, v in r.asDict().items())


def test_what_has_no_sweep(panel):
    for config, scores in ((ev.EvalConfig(methods=("ACI",)), ("abs",)), (ev.EvalConfig(methods=("SplitCP",)), ("log",))):
        with pytest.raises(ValueError, match="no sweep"):
            ev.run_sweep(panel, (0.2,), scores, config)
    with pytest.raises(ValueError, match="no sweep"):
        ev.run_sweep(panel, (0.2,), ("mad_scaled",), ev.EvalConfig(methods=("SplitCP",)), cal_windows=(3,))
