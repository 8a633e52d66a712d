"""Simultaneous intervals: radii under which all steps of a trajectory hold at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.functions.stats import conformal_rank
from calibrant.operators.copula import radii_at, ranks, split_trajectories
from calibrant.operators.pooled import order_statistics
from calibrant.sources.shared import stored

GAMMAS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5)  # fixed value: the usual learning-rate grid


def residuals(panel: DataFrame) -> DataFrame:
    return panel.withColumn("r", F.abs(F.col("y") - F.col("yhat")))


def beside(rows: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of few, a row a group (of no groups: a single row)."""
    return rows.join(F.broadcast(few), by) if by else rows.crossJoin(F.broadcast(few))


def joint_cfrnn(panel: DataFrame, alpha: float, horizon: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, h, radius): each step's conformal quantile at alpha / horizon (None: a group's own steps), over series and windows."""
    by = [*by]
    cal = residuals(panel.where("split = 'cal'"))
    if horizon is not None:
        return order_statistics(cal, [*by, "h"], "r", {"radius": lambda n: conformal_rank(n, alpha / horizon)}).drop("n")
    cal = beside(cal, panel.groupBy(*by).agg((F.max("h") + 1).alias("__horizon")), by)
    return order_statistics(cal, [*by, "h", "__horizon"], "r", {"radius": lambda n: conformal_rank(n, F.lit(float(alpha)) / F.col("__horizon"))}).drop("n", "__horizon")


def norm_max(panel: DataFrame, alpha: float, normalise: bool = True, sigma: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, h, radius): steps are divided by their mean absolute error (under 1e-8: 1), or by sigma (by, h, sigma) where it is
    given; the conformal quantile of a trajectory's largest share, times the step's error. The quantile is a row a group,
    and sigma a row per step, so they are joined by broadcast."""
    by = [*by]
    cal = residuals(panel.where("split = 'cal'"))
    if sigma is None:
        mae = F.avg("r") if normalise else F.lit(1.0)
        sigma = cal.groupBy(*by, "h").agg(F.when(mae >= 1e-8, mae).otherwise(1.0).alias("sigma"))
    top = cal.join(F.broadcast(sigma), [*by, "h"]).groupBy(*by, "series", "w").agg(F.max(F.col("r") / F.col("sigma")).alias("m"))
    c = order_statistics(top, by, "m", {"c": lambda n: conformal_rank(n, alpha)})
    return beside(sigma, c, by).select(*by, "h", (F.col("sigma") * F.col("c")).alias("radius"))


def trajectories(panel: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, series, w, split, r): a row per trajectory, r by step."""
    steps = F.sort_array(F.collect_list(F.struct("h", "r")))
    return residuals(panel).groupBy(*by, "series", "w", "split").agg(F.transform(steps, lambda x: x["r"]).alias("r"))


def walked(walk: Callable, r: Column, gamma: Column, alpha: float, q0: float) -> Column:
    """The paths of walk along the arrays r: those of a batch that have as many steps are walked together, step by step.
    walk takes r (a row a trajectory, NaN where it is null), what of it is null, and gamma; it gives thresholds and which are null."""

    @F.arrow_udf("array<double>")
    def paths(r: pa.Array, gamma: pa.Array) -> pa.Array:
        length = np.asarray(pc.fill_null(pc.list_value_length(r), 0))
        ends = np.cumsum(length)
        flat = r.flatten()
        value, null = flat.to_numpy(zero_copy_only=False).astype(float), np.asarray(flat.is_null())
        g = gamma.to_numpy(zero_copy_only=False)
        q, unknown = np.zeros(len(value)), np.zeros(len(value), bool)
        for n in np.unique(length[length > 0]):
            own = np.flatnonzero(length == n)
            at = (ends[own] - n)[:, None] + np.arange(n)
            q[at], unknown[at] = walk(value[at], null[at], g[own], float(alpha), float(q0))
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(q, mask=unknown), mask=r.is_null())

    return paths(r, gamma)


def _over(s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """s > q in SQL's order, in which NaN is the largest."""
    return (s > q) | (np.isnan(s) & ~np.isnan(q))


def _aci_walk(r: np.ndarray, null: np.ndarray, gamma: np.ndarray, alpha: float, q0: float) -> tuple[np.ndarray, np.ndarray]:
    a, q, unknown = np.full(len(r), alpha), np.empty_like(r), np.zeros(r.shape, bool)
    for i in range(r.shape[1]):
        k = np.clip(np.ceil(i * (1 - a)).astype(int) - 1, 0, max(i - 1, 0))
        few = i < np.ceil(1 / np.maximum(a, 1e-9))
        seen = np.sort(r[:, :i], axis=1) if i else np.full((len(r), 1), np.nan)  # nulls come last
        q[:, i] = np.where(few, q0, seen[np.arange(len(r)), k])
        unknown[:, i] = ~few & (k >= i - null[:, :i].sum(axis=1))
        above = _over(r[:, i], q[:, i]) & ~null[:, i] & ~unknown[:, i]
        a = np.clip(a + gamma * (alpha - above), 0.0, 1.0)
    return q, unknown


def _pid_walk(r: np.ndarray, null: np.ndarray, gamma: np.ndarray, alpha: float, q0: float) -> tuple[np.ndarray, np.ndarray]:
    qt, lost, q = np.full(len(r), q0), np.zeros(len(r), bool), np.empty_like(r)
    for i in range(r.shape[1]):
        q[:, i] = np.where(lost, 0.0, np.maximum(qt, 0.0))  # after a past of nulls alone the tracked value is null
        grad = np.where(~null[:, i] & ~_over(r[:, i], q[:, i] if i else qt), alpha, alpha - 1.0)
        rate = gamma
        if i > 1:
            known = ~null[:, :i]
            most = np.where(known, r[:, :i], -np.inf).max(axis=1)
            rate = gamma * (most - np.fmin.reduce(r[:, :i], axis=1))
            lost |= ~known.any(axis=1)
        qt = qt - rate * grad
    return q, np.zeros(r.shape, bool)


def aci_path(r: Column, gamma: Column, alpha: float, q0: float) -> Column:
    """Thresholds along a trajectory by adaptive conformal inference, from nothing but q0."""
    return walked(_aci_walk, r, gamma, alpha, q0)


def pid_path(r: Column, gamma: Column, alpha: float, q0: float) -> Column:
    """Thresholds along a trajectory by quantile tracking; never below 0."""
    return walked(_pid_walk, r, gamma, alpha, q0)


def cafht(panel: DataFrame, alpha: float, cal_windows: int | None = None, path=aci_path, gammas: tuple[float, ...] = GAMMAS, cal_split: float = 0.5, q0: float = 0.1, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, series, w, radii) of the test trajectories, with gamma and eps.

    The first half of the calibration windows (cal_windows; None: those that a group has) chooses gamma (least mean band),
    the others eps (the conformal quantile of the largest relative violation); radii are (1 + eps) times the trajectory's
    own path of thresholds. Choices are rows of the size of the gamma grid, for each group.
    """
    by = [*by]
    paths = stored(trajectories(panel.where("split != 'skip'"), tuple(by)), "trajectories")
    own = F.col("__windows")
    paths = beside(paths, paths.where("split = 'cal'").groupBy(*by).agg(F.countDistinct("w").alias("__windows")), by) if cal_windows is None else paths.withColumn("__windows", F.lit(cal_windows))
    first = F.greatest(F.lit(1), F.least(F.floor(F.lit(float(cal_split)) * own), own - 1))
    grid = panel.sparkSession.createDataFrame([(g,) for g in gammas], "gamma double")
    violation = F.array_max(F.zip_with("r", "qs", lambda r, q: F.greatest(r - q, F.lit(0.0)) / F.greatest(q, F.lit(1e-8))))
    stage1 = paths.where((F.col("split") == "cal") & (F.col("w") < first)).crossJoin(F.broadcast(grid)).withColumn("qs", path(F.col("r"), F.col("gamma"), alpha, q0))
    stage1 = stage1.select(*by, "gamma", violation.alias("v"), (F.aggregate("qs", F.lit(0.0), lambda s, q: s + q) / F.size("qs")).alias("q"))
    stage1 = stored(stage1, "tried")  # the paths are walked once
    tried = order_statistics(stage1, [*by, "gamma"], "v", {"c": lambda n: conformal_rank(n, alpha)}).join(stage1.groupBy(*by, "gamma").agg(F.avg("q").alias("mean_q")), [*by, "gamma"])
    band = tried.select(*by, "gamma", ((1 + F.col("c")) * 2 * F.col("mean_q")).alias("band"))
    best = band.groupBy(*by).agg(F.min_by("gamma", F.struct(F.round("band", 9), "gamma")).alias("gamma"))
    stage2 = beside(paths.where((F.col("split") == "cal") & (F.col("w") >= first)), best, by).withColumn("qs", path(F.col("r"), F.col("gamma"), alpha, q0))
    eps = order_statistics(stored(stage2.select(*by, "gamma", violation.alias("v")), "tried"), [*by, "gamma"], "v", {"eps": lambda n: conformal_rank(n, alpha)}).drop("n")
    test = beside(paths.where("split = 'test'"), eps, by).withColumn("qs", path(F.col("r"), F.col("gamma"), alpha, q0))
    return test.select(*by, "series", "w", "gamma", "eps", F.transform("qs", lambda q: (1 + F.col("eps")) * q).alias("radii"))


def copula_bisection(panel: DataFrame, alpha: float, cal_split: float = 0.6, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, h, radius): one probability for all steps, the level at which the empirical copula reaches 1 - alpha; radii
    are that linear quantile of each step's errors.

    The first trajectories, in order of window and series, give the errors' distributions, the others the copula.
    The bisection's limit is the order statistic of each trajectory's largest rank at ceil(n (1 - alpha)).
    """
    by = [*by]
    cal = residuals(panel.where("split = 'cal'")).select(*by, "series", "w", "h", "r").where("r IS NOT NULL")
    placed = stored(split_trajectories(cal, cal_split, by), "copula-errors")
    top = ranks(placed, by).groupBy(*by, "series", "w").agg(F.max("u").alias("u"))
    theta = order_statistics(top, by, "u", {"theta": lambda n: F.ceil(n * F.lit(1 - alpha))}).select(*by, F.least("theta", F.lit(1.0)).alias("theta"))
    base = placed.where("base")
    return radii_at(base, beside(base.select(*by, "h").distinct(), theta, by), by)


def radii_of(paths: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, series, w, h, radius) of trajectories with an array of radii."""
    return paths.select(*by, "series", "w", F.posexplode("radii").alias("h", "radius"))


def with_radii(panel: DataFrame, radii: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Test rows with lo and hi; radii is a row per step, or per trajectory and step (of each group)."""
    keys = [c for c in (*by, "series", "w", "h") if c in radii.columns]
    test = panel.where("split = 'test'").join(F.broadcast(radii) if keys == [*by, "h"] else radii, keys)
    return test.withColumn("lo", F.col("yhat") - F.col("radius")).withColumn("hi", F.col("yhat") + F.col("radius"))
