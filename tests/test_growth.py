"""Steps whose work has to grow with the rows, not with their square, nor with a run of the panel for each pass."""

import re
from time import perf_counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF
from pyspark.sql import functions as F

from calibrant.functions import forecasters as fc
from calibrant.operators import joint as jp
from calibrant.operators import kernels as kn
from calibrant.operators import scales as sc
from calibrant.operators import segments as sg
from calibrant.operators.pooled import order_statistics
from calibrant.plans import catalog
from calibrant.sources.shared import shared_path
from calibrant.streaming.online import online_aci, run_available


@pytest.mark.parametrize("name", ["moving_average", "drift", "last"])
def test_forecast_of_a_long_past_takes_one_walk(spark, name):
    """A past's mean, slope and sorted errors are made once, not for each value, level and step."""
    past = F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: (i % 7).cast("double"))
    spark.range(1).select(past.alias("past")).where(F.size("past") > 0).count()
    began = perf_counter()
    rows = fc.predict(spark.range(1).select(past.alias("past")), name, 4).select("h", "yhat", "q.q10", "q.q90").collect()
    assert perf_counter() - began < 20 and len(rows) == 4 and all(r["q10"] <= r["q90"] for r in rows)


@pytest.mark.parametrize("name", ["spci_forest", "agaci", "dtaci", "dtaci_drawn", "adaptive_cqr_kernels", "acmcp", "run_kernels"])
def test_kernels_take_blocks_of_keys(spark, name):
    """A call, a frame and a batch for each of very many short keys cost more than the kernels."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan


def test_keys_over_batches_and_blocks(monkeypatch):
    monkeypatch.setattr(kn, "BLOCK_KEYS", 3)
    names = [k for k, n in enumerate([1, 5, 2, 9, 1, 1, 4, 3]) for _ in range(n)]
    table = pa.table({"k": names, "v": list(range(len(names)))})
    for size in (1, 2, 4, 100):
        blocks = list(kn.whole_keys(iter(table.to_batches(max_chunksize=size)), 1))
        assert [k for _, own, _ in blocks for (k,) in own] == list(range(8)) and max(len(own) for _, own, _ in blocks) == 3
        assert pa.concat_tables(b for b, _, _ in blocks) == table
        assert all(set(b["k"].to_pylist()[i:j]) == {k} for b, own, at in blocks for (k,), i, j in zip(own, at, at[1:]))


def test_forests_of_many_keys_equal_one_by_one():
    rng = np.random.default_rng(5)
    cal = [np.round(rng.normal(size=rng.integers(0, 9)), k % 3) for k in range(24)]
    test = [np.round(rng.normal(size=rng.integers(1, 14)), k % 3) for k in range(24)]
    for x in test[::5]:
        x[rng.integers(0, len(x))] = np.nan
    for options in ({}, {"retrain": 2}, {"depth": 3, "trees": 3}):
        many = kn.spci_many(cal, test, list(range(24)), 0.2, w=5, **options)
        for k in range(24):
            assert np.array_equal(many[k], kn.spci(cal[k], test[k], 0.2, w=5, seed=k, **options))


@pytest.mark.parametrize("name", ["run_joint", "keyed_joint", "keyed_joint_folds", "keyed_folds", "score_asym_pair", "score_scaled_cqr", "invert_mad_scaled", "run_sweep", "past_quantiles_pooled"])
def test_panel_is_made_once(spark, name):
    """What is passed over several times is stored: no pass goes back to the events."""
    assert not [f for f in catalog.QUERIES[name](spark, SF).inputFiles() if "events" in f]


def test_rounds_do_not_grow_with_a_key(spark, monkeypatch):
    rows = spark.range(200).select(F.lit("a").alias("series"), F.col("id").alias("w"), F.when(F.col("id") < 20, "cal").otherwise("test").alias("split"), (F.col("id") * 37 % 101).cast("double").alias("s"))
    names, kept = [], sg.stored
    monkeypatch.setattr(sg, "stored", lambda df, name: names.append(name) or kept(df, name))
    short = {(r["w"], r["thr"], r["alpha_t"]) for r in sg.aci(rows, ["series"], 0.2, 0.05, 20, segment=3).collect()}
    assert names.count("segment") <= sg.ROUNDS
    assert short == {(r["w"], r["thr"], r["alpha_t"]) for r in sg.aci(rows, ["series"], 0.2, 0.05, 20).collect()}


def test_stream_keeps_keys_by_bucket(spark):
    base = shared_path(spark, "buckets")
    scores = spark.range(400).select((F.col("id") % 40).cast("string").alias("key"), F.floor(F.col("id") / 40).alias("w"), (F.col("id") * 37 % 101).cast("double").alias("s"))
    got = {}
    for k in (0, 1):
        scores.where(f"w {'>=' if k else '<'} 5").write.mode("append").parquet(f"{base}/in")
        out = online_aci(spark.readStream.schema(scores.schema).parquet(f"{base}/in"), ["key"], 0.2, 0.05, 20, buckets=4)
        got = {(r["key"], r["w"]): (r["thr"], r["alpha_t"]) for r in run_available(out, f"{base}/out", f"{base}/state").collect()}
    assert 0 < spark.read.format("statestore").load(f"{base}/state").count() <= 4
    whole = sg.aci(scores.withColumn("split", F.lit("test")), ["key"], 0.2, 0.05, 20).collect()
    assert got == {(r["key"], r["w"]): (r["thr"], r["alpha_t"]) for r in whole}


def test_forecast_is_made_once_a_block(spark):
    """No step gathers a past of its own: pasts are joined from blocks of the horizon's steps, after one shuffle."""
    plan = catalog.QUERIES["panel_user"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    frames = [int(x) for x in re.findall(r"RowFrame, (-\d+), ", plan)]
    assert frames == [-4]  # four blocks of four steps, not sixteen steps


def test_scales_are_passes_over_stored_medians(spark, monkeypatch):
    """The plans that read the first medians don't each make them anew."""
    names, kept = [], sc.stored
    monkeypatch.setattr(sc, "stored", lambda df, name: names.append(name) or kept(df, name))
    catalog.QUERIES["score_asym_pair"](spark, SF)
    assert names == ["scaled", "medians"]


def test_ranks_of_one_bracket_share_its_rows(spark):
    """Two ranks side by side don't double the rows that are counted."""
    rows = spark.range(20_000).select(F.pmod(F.xxhash64("id"), F.lit(997)).cast("double").alias("v"))
    both = order_statistics(rows, [], "v", {"a": lambda n: n / 2, "b": lambda n: n / 2 + 1})
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert "asked" in plan and sorted(r["v"] for r in rows.collect())[9_999:10_001] == [*both.select("a", "b").first()]


@pytest.mark.parametrize("name", ["cafht_aci", "cafht_pid"])
def test_trajectories_are_walked_by_batch(spark, name):
    """A lambda a step of each trajectory and rate cost more than the walk."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan


def test_walks_of_odd_trajectories(spark):
    """Several lengths in a batch; nulls sort last, and no array gives none."""
    nan = float("nan")
    rows = [[0.4, 0.3, 0.2, 0.1], [None, None, 0.3, 0.0, 9.0], [nan, 0.5], [], None, [0.2]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r array<double>").coalesce(1)
    got = [r["q"] for r in df.select("i", jp.aci_path(F.col("r"), F.lit(0.5), 0.5, 0.1).alias("q")).orderBy("i").collect()]
    # by hand: the level 0.5 moves by -0.25 after a score over the threshold, else by 0.25
    assert got[0] == [0.1, 0.1, 0.1, 0.1] and got[3:] == [[], None, [0.1]]
    assert got[1] == [0.1, 0.1, None, 0.3, 0.0] and got[2] == [0.1, 0.1]
    pid = [r["q"] for r in df.select("i", jp.pid_path(F.col("r"), F.lit(0.5), 0.5, 0.1).alias("q")).orderBy("i").collect()]
    assert pid[0] == pytest.approx([0.1, 0.35, 0.1, 0.125]) and pid[3:] == [[], None, [0.1]]
