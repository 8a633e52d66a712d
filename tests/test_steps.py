"""Queries over the user panel take every step of it."""

import numpy as np
import pytest
from oracle import SF, plain

from calibrant.operators import kernels as kn
from calibrant.plans import catalog


@pytest.mark.parametrize("name, twin", [("stream_aci", "aci"), ("stream_trailing", "trailing_window")])
def test_stream_takes_every_step(spark, name, twin):
    mine = {(r["series"], r["h"], r["w"]): plain(r["thr"]) for r in catalog.QUERIES[name](spark, SF).collect()}
    panel = catalog.user_scores(spark, SF).where("split = 'test'").select("series", "h", "w").collect()
    assert set(mine) == {tuple(r) for r in panel} and {h for _, h, _ in mine} == {0, 1, 2, 3}
    if twin == "aci":
        assert mine == {(r["series"], r["h"], r["w"]): plain(r["thr"]) for r in catalog.QUERIES[twin](spark, SF).collect()}


def test_forest_takes_every_step(spark):
    mine = {(r["series"], r["h"], r["w"]): (r["q_lo"], r["q_up"]) for r in catalog.QUERIES["spci_forest"](spark, SF).collect()}
    rows = catalog._errors(spark, SF).select("series", "h", "w", "split", "e").toPandas()
    expected = {}
    for (series, h), g in rows.sort_values("w").groupby(["series", "h"]):
        test = g[g["split"] == "test"]
        lo, up = kn.spci(g.loc[g["split"] == "cal", "e"].to_numpy(float), test["e"].to_numpy(float), catalog.ALPHA, w=5, bins=5, seed=kn.key_seed(str(series), str(h)))
        expected |= {(series, h, w): q for w, *q in zip(test["w"], np.round(lo, 6), np.round(up, 6))}
    assert set(mine) == set(expected) and {h for _, h, _ in mine} == {0, 1, 2, 3}
    assert all(mine[k] == pytest.approx(tuple(expected[k]), abs=2e-6) for k in mine)
