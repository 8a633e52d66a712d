"""Scans over segments and quantiles of unbounded pasts, against the plans that hold a key in one row."""

import random
import time

import pytest
from pyspark.sql import functions as F

from calibrant.functions.stats import conformal_quantile
from calibrant.operators import calibrate as cp
from calibrant.operators import ranks as rk
from calibrant.operators import segments as sg

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def rows(spark):
    """Keys of three lengths, one of them null; ties, and scores that don't count."""
    rng = random.Random(1)
    made = [(k, t, "cal" if t < 20 else "test", rng.choice([None, NAN, INF]) if rng.random() < 0.06 else round(rng.gauss(0, 1), 1) ** 2, f"c{t}") for k, n in (("a", 300), ("b", 40), (None, 25)) for t in range(n)]
    return spark.createDataFrame(made, "series string, w int, split string, s double, note string")


@pytest.fixture(scope="module")
def clean(rows):
    """The scores as runners give them: finite or null."""
    return rows.withColumn("s", F.when(~F.isnan("s") & (F.abs("s") < INF), F.col("s")))


def of(df) -> list:
    return sorted(((r["series"], r["w"], r["thr"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("segment", [1000, 64, 30])
def test_segments_equal_the_whole(rows, clean, segment):
    keys = ["series"]
    assert of(sg.aci(rows, keys, 0.2, 0.05, 20, segment=segment)) == of(cp.aci(clean, keys, 0.2, 0.05, 20))
    assert of(sg.trailing(rows, keys, 0.2, 20, segment=segment)) == of(cp.trailing(clean, keys, 0.2, 20))
    assert of(sg.weighted(rows, keys, 0.2, 20, 0.95, segment=segment)) == of(cp.weighted(clean, keys, 0.2, 20, 0.95))
    q0 = clean.where("split = 'cal' AND s IS NOT NULL").groupBy(F.col("series").alias("k")).agg(conformal_quantile(F.array_sort(F.collect_list("s")), 0.2).alias("q0"))
    begun = rows.join(q0, F.col("series").eqNullSafe(F.col("k"))).drop("k")
    for ki in (0.0, 0.5):
        assert of(sg.pid(begun, keys, 0.2, ki=ki, size=20, segment=segment)) == of(cp.pid(clean, keys, 0.2, ki=ki, size=20))


def test_lookback_over_several_segments(rows, clean):
    assert of(sg.trailing(rows, ["series"], 0.2, 50, segment=15)) == of(cp.trailing(clean, ["series"], 0.2, 50))


def test_own_weights_and_carried_columns(rows, clean):
    weights = (0.1, 0.0, 2.0, 1.0)
    assert of(sg.scan(rows, ["series"], sg.Weighted(0.2, 20, weights=weights))) == of(cp.weighted(clean, ["series"], 0.2, 20, weights=weights))
    got = sg.aci(rows, ["series"], 0.2, carry=("note",), segment=50)
    assert got.columns == ["series", "w", "note", "s", "thr", "alpha_t"] and got.where("note = concat('c', w)").count() == got.count() == 305


def test_no_rows(rows):
    none = rows.where("false")
    assert sg.aci(none, ["series"], 0.2).count() == 0 and sg.trailing(none, ["series"], 0.2, segment=1).count() == 0 and rk.past_quantiles(none, ["series"], 0.2).count() == 0


@pytest.mark.parametrize("block", [4096, 50, 7])
def test_past_quantiles_equal_the_sorted_past(rows, clean, block):
    assert of(rk.past_quantiles(rows, ["series"], 0.2, block=block)) == of(cp.trailing(clean, ["series"], 0.2, None, correction=True))
    assert of(rk.past_quantiles(rows, ["series"], 0.4, correction=False, block=block)) == of(cp.trailing(clean, ["series"], 0.4, None))


def test_place_counts_over_ranges(rows):
    got = sg.with_place(rows, ["series"], ["w"], "p", F.col("s").isNotNull()).collect()
    own = {}
    for r in sorted(rows.collect(), key=lambda r: (repr(r["series"]), r["w"])):
        k = (r["series"], r["w"])
        own[k] = own.setdefault(r["series"], 0)
        own[r["series"]] += r["s"] is not None
    assert all(r["p"] == own[r["series"], r["w"]] for r in got) and len(got) == 365


def test_ordered_list_by_brute_force():
    rng, o, plain = random.Random(2), rk.Ordered(), []
    o.LOAD = 8
    for k in range(2000):
        v = rng.choice([rng.random(), 0.5, -1.0])
        o.add(v)
        plain.append(v)
        if k % 37 == 0:
            plain.sort()
            assert [o.place(i + 1) for i in range(len(plain))] == plain
    with pytest.raises(IndexError):
        o.place(2001)


def test_a_key_of_a_million_steps(spark):
    """One key, ten segments: the fold by hand over the same scores."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("one").alias("series"), F.col("id").cast("int").alias("w"), F.when(F.col("id") < 100, "cal").otherwise("test").alias("split"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0).alias("s"))
    began = time.time()
    last = sg.aci(rows, ["series"], 0.2, 0.05, 100).where(f"w >= {n - 3}").orderBy("w").collect()
    took = time.time() - began
    method = sg.Adaptive(0.2, 100, 0.05)
    state, expected = method.start(), []
    for r in rows.select("w", "s").toLocalIterator():
        if r["w"] >= 100:
            expected = [*expected[-2:], (r["w"], *method.test(state, r["s"], None))]
        method.see(state, r["s"])
    assert [(r["w"], r["thr"], r["alpha_t"]) for r in last] == expected
    assert took < 300
