"""Kept evaluations: what is computed anew, and what is read."""

import pytest
from oracle import SF
from pyspark.sql import functions as F

from calibrant.plans import cache as ch
from calibrant.plans import evaluate as ev
from calibrant.sources import panels as ps
from calibrant.sources import store
from calibrant.sources.shared import shared_path


@pytest.fixture(scope="module")
def panel(spark):
    path = shared_path(spark, "kept")
    store.write_panel(ps.user_panel(spark, SF).where("series < '5'").withColumns({"task": F.lit("t"), "model": F.lit("m")}), path)
    return path


def by_method(rows) -> dict:
    return {r["method"]: r.asDict() for r in rows.collect()}


def test_only_what_is_new_is_computed(spark, panel, monkeypatch):
    root, asked = shared_path(spark, "results"), []
    real = ev.every_interval
    monkeypatch.setattr(ev, "every_interval", lambda p, c, k, n=True: asked.append(c.methods) or real(p, c, k, n))
    config = ev.EvalConfig(methods=("SplitCP", "ACI", "TrailingWindow"), window=20)
    first = by_method(ch.run_cached(spark, panel, config, root))
    again = by_method(ch.run_cached(spark, panel, config, root))
    more = by_method(ch.run_cached(spark, panel, ev.EvalConfig(methods=("SplitCP", "ACI", "TrailingWindow", "PID"), window=20), root))
    assert asked == [("SplitCP", "ACI", "TrailingWindow"), ("PID",)]
    assert all(r["computed"] for r in first.values()) and not any(r["computed"] for r in again.values())
    assert {m for m, r in more.items() if r["computed"]} == {"PID"}
    plain = by_method(ev.run(store.read_panel(spark, panel), ev.EvalConfig(methods=("SplitCP", "ACI", "TrailingWindow", "PID"), window=20), ("task", "model", "series")))
    assert set(plain) == set(more)
    for m, r in plain.items():
        assert all(more[m][c] == pytest.approx(v) for c, v in r.items())
    # A static method knows no window; one that looks back does.
    wider = by_method(ch.run_cached(spark, panel, ev.EvalConfig(methods=("SplitCP", "TrailingWindow"), window=5), root))
    assert {m for m, r in wider.items() if r["computed"]} == {"TrailingWindow"}
    forced = by_method(ch.run_cached(spark, panel, ev.EvalConfig(methods=("SplitCP",)), root, force=True))
    assert all(r["computed"] for r in forced.values())


def test_a_changed_panel_and_other_rows_are_other_entries(spark):
    path, root = shared_path(spark, "kept"), shared_path(spark, "results")
    rows = ps.user_panel(spark, SF).where("series < '3'").withColumns({"task": F.lit("t"), "model": F.lit("m")})
    store.write_panel(rows.where("h < 2"), path)
    config = ev.EvalConfig(methods=("SplitCP",))
    before = ch.snapshot(spark, path)
    ch.run_cached(spark, path, config, root)
    part = by_method(ch.run_cached(spark, path, config, root, where="h = 0"))
    assert part["SplitCP"]["computed"]
    store.write_panel(rows, path)
    assert ch.snapshot(spark, path) != before
    assert by_method(ch.run_cached(spark, path, config, root))["SplitCP"]["computed"]


def test_an_entry_that_was_cut_short_is_made_again(spark, panel):
    root = shared_path(spark, "results")
    config = ev.EvalConfig(methods=("SplitCP",))
    ch.run_cached(spark, panel, config, root)
    keys = ch.entry_keys(config, ch.snapshot(spark, panel), None, ("task", "model", "series"))
    cut = lambda kind: ch._files(spark, f"{root}/{kind}/{keys['SplitCP']}/_SUCCESS")
    for kinds, anew in ((["metrics"], False), (["metrics", "intervals"], True)):
        for kind in kinds:
            fs, p = cut(kind)
            assert fs.delete(p, False)
        got = by_method(ch.run_cached(spark, panel, config, root))
        assert got["SplitCP"]["computed"] == anew and not got["Native"]["computed"]  # kept intervals give the metrics


def test_two_models_under_one_series_are_refused(spark):
    rows = ps.user_panel(spark, SF).where("series < '3'")
    both = rows.withColumn("model", F.lit("a")).union(rows.withColumn("model", F.lit("b")))
    with pytest.raises(Exception, match="name more keys"):
        ev.run(both, ev.EvalConfig(methods=("SplitCP",))).collect()
    assert ev.run(both, ev.EvalConfig(methods=("SplitCP",)), ("model", "series")).count() == 4


def test_groups_have_horizons_of_their_own(spark):
    """Under one plan, a task of two steps and one of four get the levels that each has alone."""
    rows = ps.user_panel(spark, SF)
    both = rows.where("h < 2").withColumn("task", F.lit("short")).union(rows.withColumn("task", F.lit("long")))
    config = ev.EvalConfig(methods=("CFRNN",))
    got = {(r["task"], r["method"]): r["avg_width"] for r in ev.run(both, config, ("task", "series")).collect()}
    for task, own in (("short", rows.where("h < 2")), ("long", rows)):
        assert {r["method"]: r["avg_width"] for r in ev.run(own, config).collect()} == pytest.approx({m: v for (t, m), v in got.items() if t == task})
    joint = {r["task"]: r["avg_width"] for r in ev.run_joint(both, ev.EvalConfig(methods=("JointCFRNN",)), ("task", "series")).collect()}
    assert joint["short"] == pytest.approx(ev.run_joint(rows.where("h < 2"), ev.EvalConfig(methods=("JointCFRNN",))).first()["avg_width"])


@pytest.mark.parametrize("methods", [("TrailingWindow", "ACI", "WeightedCP", "PID")])
def test_asymmetric_folds_walk_each_tail(spark, methods):
    rows = ps.user_panel(spark, SF)
    got = ev.run_folds(rows, ev.EvalConfig(methods=methods, score="cqr", asymmetric=True, window=20), 3).collect()
    assert {r["method"] for r in got} == {"Native", *methods} and len(got) == 15 and all(0 <= r["coverage"] <= 1 for r in got)
