"""Online states over several micro-batches: late rows, resets, keys that expire."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from calibrant.operators.segments import Adaptive
from calibrant.sources.shared import shared_path
from calibrant.streaming.online import online_aci, run_available
from calibrant.streaming.stateful import PROVIDER, adaptive_levels, levels_now, run_files

SHAPE = "key string, w bigint, s double, at timestamp, reset boolean"
DAY0 = dt.datetime(2024, 1, 1)


def row(key, w, s, day=None, reset=False):
    return (key, w, s, DAY0 + dt.timedelta(days=w if day is None else day), reset)


def walked(scores, alpha=0.2, gamma=0.05, size=20):
    """(thr, alpha_t) of a key's scores from nothing."""
    method = Adaptive(alpha, size, gamma)
    state, out = method.start(), []
    for s in scores:
        out.append(method.test(state, s, None))
        method.see(state, s) if s is not None else None
    return out


def fed(spark, batches):
    """A stream of a file a batch."""
    path = shared_path(spark, "fed")
    for rows in batches:
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def ran(spark):
    """Two keys over four batches: a late row, a missing score, a reset, and one key that stays away for 60 days."""
    a = [1.0, 3.0, 2.0, None, 5.0, 0.5, 4.0]
    batches = [
        [row("a", w, x) for w, x in enumerate(a[:3])] + [row("b", 0, 9.0)],
        [row("a", 3, a[3]), row("a", 1, 7.0, 3), row("a", 4, a[4])],
        [row("a", 5, a[5], 62), row("a", 6, a[6], 63)],
        [row("a", 7, 2.5, 64, True), row("b", 1, 8.0, 64), row("b", 2, 6.0, 65)],
    ]
    at = shared_path(spark, "stateful")
    made = adaptive_levels(fed(spark, batches), ["key"], 0.2, 0.05, 20, idle=50 * 86_400)
    rows = run_files(made, f"{at}/out", f"{at}/state").collect()
    return at, a, {(r["key"], r["w"], r["late"]): (r["thr"], r["alpha_t"]) for r in rows}


def test_batches_in_order_equal_one_walk(ran):
    _, a, got = ran
    assert [got["a", w, 0] for w in range(7)] == walked(a)


def test_late_rows_are_counted_and_change_nothing(ran):
    _, _, got = ran
    assert got["a", 1, 1] == (None, None) and len([k for k in got if k[2]]) == 1


def test_a_reset_starts_a_key_anew(ran):
    assert ran[2]["a", 7, 0] == walked([2.5])[0]


def test_a_key_that_expired_starts_anew(ran):
    _, _, got = ran
    assert [got["b", w, 0] for w in (0, 1, 2)] == [walked([9.0])[0], *walked([8.0, 6.0])]


def test_state_can_be_read_back(spark, ran):
    rows = {r["key"]: r for r in levels_now(spark, f"{ran[0]}/state").collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["last"] == 7 and rows["a"]["late"] == 1 and rows["b"]["last"] == 2
    assert spark.conf.get(PROVIDER, None) != "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_the_plain_state_over_batches(spark):
    scores = [float(k % 5) for k in range(30)]
    made = online_aci(fed(spark, [[row("k", w, scores[w]) for w in range(k, k + 10)] for k in (0, 10, 20)]).drop("at", "reset"), ["key"], 0.2, 0.05, 20)
    at = shared_path(spark, "plain")
    got = run_available(made, f"{at}/out", f"{at}/state").orderBy(F.col("w")).collect()
    assert [(r["thr"], r["alpha_t"]) for r in got] == walked(scores)
