"""Copula calibration of trajectories: a probability for each step, and the errors' quantiles at them.

The first calibration trajectories, in order of window and series, give the errors' distributions; the others' ranks under
these are the copula. Ranks and quantiles are counted by ranges of the sorted errors, and the fit's gradient is an
aggregate of as many numbers as there are steps, so no task holds a step's errors or all trajectories.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice
from math import sqrt

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibrant.operators.pooled import order_statistics
from calibrant.operators.segments import with_place
from calibrant.sources.shared import stored

#: The soft indicator's steepness, Adam's moments, and where logits are held.
STEEP, BETA1, BETA2, TINY, HELD = 20.0, 0.9, 0.999, 1e-8, 6.0

#: Trajectories of a block of the fit.
BLOCK = 16_384


def split_trajectories(errors: DataFrame, cal_split: float, by: list[str]) -> DataFrame:
    """errors (by, series, w, h, r) with base: whether the trajectory is among the first of its group."""
    windows = errors.groupBy(*by, "w").agg(F.countDistinct("series").alias("n"))  # a row a window
    of_group = Window.partitionBy(*by)
    windows = windows.withColumn("before", F.sum("n").over(of_group.orderBy("w")) - F.col("n")).withColumn("first", F.floor(F.lit(cal_split) * F.sum("n").over(of_group)))
    inside = F.dense_rank().over(Window.partitionBy(*by, "w").orderBy("series"))
    return errors.join(F.broadcast(windows), [*by, "w"]).withColumn("base", F.col("before") + inside <= F.col("first")).drop("n", "before", "first")


def ranks(placed: DataFrame, by: list[str]) -> DataFrame:
    """by, series, w, h, u of the later trajectories: the share of the step's base errors that an error reaches."""
    counted = with_place(placed.withColumn("later", ~F.col("base")), [*by, "h"], ["r", "later", "w", "series"], "below", F.col("base"))
    n = placed.where("base").groupBy(*by, "h").agg(F.count("r").alias("n"))
    return counted.where("later").join(F.broadcast(n), [*by, "h"]).select(*by, "series", "w", "h", (F.col("below") / F.col("n")).alias("u"))


def radii_at(base: DataFrame, theta: DataFrame, by: list[str]) -> DataFrame:
    """(by, h, radius): the linear quantile of each step's base errors at theta (by, h, theta)."""
    own = base.join(F.broadcast(theta), [*by, "h"])
    low = lambda n: F.floor(F.col("theta") * (n - 1)) + 1
    both = order_statistics(own, [*by, "h", "theta"], "r", {"a": low, "b": lambda n: low(n) + 1})
    at = F.col("theta") * (F.col("n") - 1)
    return both.select(*by, "h", (F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))).alias("radius"))


def matrices(rows: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of rows (group's number, u0, u1, ..) as arrays; a missing rank is NaN."""
    while block := [*islice(rows, BLOCK)]:
        m = np.array(block, dtype=float)
        yield m[:, 0].astype(np.int64), m[:, 1:]


def slopes(theta: np.ndarray) -> Callable[[tuple[np.ndarray, np.ndarray]], Iterator[tuple[int, np.ndarray]]]:
    """Of a block, by group: the number of its trajectories, and the sums of their soft coverage and its slope by each step of
    theta (a row a group). A missing step is covered."""

    def of(block: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        group, u = block
        s = np.where(np.isnan(u), 1.0, 1.0 / (1.0 + np.exp(-STEEP * (theta[group] - u))))
        p = s.prod(axis=1)
        there, own = np.unique(group, return_inverse=True)
        sums = [np.bincount(own, x) for x in (np.ones(len(p)), p, *(p[:, None] * STEEP * (1 - s)).T)]
        yield from zip(there.tolist(), np.column_stack(sums))

    return of


def fit(vectors: DataFrame, by: list[str], steps: int, alpha: float, epochs: int, lr: float) -> dict[tuple, np.ndarray]:
    """Probabilities by step of each group of vectors (by, u0, u1, ..; null where a trajectory has no such step), by Adam on
    the distance of the soft joint coverage from 1 - alpha. The vectors are kept as blocks of numbers by the executors; an
    epoch is one aggregate over these, whose result is a row a group (of a single group: a row a block). Groups go
    through their epochs together."""
    spark = vectors.sparkSession
    groups = [tuple(r) for r in vectors.select(*by).distinct().collect()] if by else ([()] if not vectors.isEmpty() else [])
    if not groups:
        return {}
    own = F.lit(0).alias("__group")
    if by:
        types = ", ".join([f"`{k}` {t}" for k, t in vectors.dtypes if k in by])
        vectors = vectors.join(F.broadcast(spark.createDataFrame([(*g, i) for i, g in enumerate(groups)], f"{types}, __group int")), by)
        own = F.col("__group")
    blocks = vectors.select(own, *[f"u{h}" for h in range(steps)]).rdd.mapPartitions(matrices).persist(StorageLevel.MEMORY_AND_DISK)
    logit, m, v = (np.full((len(groups), steps), x) for x in (min(max(1.0 - alpha, 0.01), 0.99), 0.0, 0.0))
    for epoch in range(1, epochs + 1):
        theta = 1 / (1 + np.exp(-logit))
        sums = blocks.flatMap(slopes(theta))
        total = np.zeros((len(groups), steps + 2))
        for i, x in (sums.reduceByKey(np.add) if by else sums).collect():
            total[i] += x
        mean = total[:, 1:] / np.maximum(total[:, :1], 1)
        slope = np.sign(mean[:, :1] - (1.0 - alpha)) * mean[:, 1:] * theta * (1 - theta)
        m = BETA1 * m + (1 - BETA1) * slope
        v = BETA2 * v + (1 - BETA2) * slope**2
        moved = lr * (m / (1 - BETA1**epoch)) / (np.sqrt(v) / sqrt(1 - BETA2**epoch) + TINY)
        logit = np.clip(logit - moved, -HELD, HELD)
    blocks.unpersist()
    return dict(zip(groups, 1 / (1 + np.exp(-logit))))


def adam_radii(panel: DataFrame, alpha: float, by: tuple[str, ...] = (), cal_split: float = 0.6, epochs: int = 500, lr: float = 0.01) -> DataFrame:
    """(by, h, radius) of calibration rows (by, series, w, h, y, yhat). Probabilities begin at the sigmoid of 1 - alpha,
    held within 0.01 and 0.99. A group without later trajectories has no radii."""
    by, spark = [*by], panel.sparkSession
    errors = panel.where("split = 'cal'").select(*by, "series", "w", "h", F.abs(F.col("y") - F.col("yhat")).alias("r")).where("r IS NOT NULL")
    placed = stored(split_trajectories(errors, cal_split, by), "copula-errors")
    steps = (placed.agg(F.max("h")).first()[0] or 0) + 1
    vectors = ranks(placed, by).groupBy(*by, "series", "w").agg(*[F.max(F.when(F.col("h") == h, F.col("u"))).alias(f"u{h}") for h in range(steps)])
    vectors = stored(vectors.select(*by, *[f"u{h}" for h in range(steps)]), "copula-ranks")
    found = fit(vectors, by, steps, alpha, epochs, lr)
    kinds = dict(placed.dtypes)
    theta = spark.createDataFrame([(*g, h, float(x)) for g, t in found.items() for h, x in enumerate(t)], ", ".join([*[f"`{k}` {kinds[k]}" for k in by], f"h {kinds['h']}", "theta double"]))
    return radii_at(placed.where("base"), theta, by)
