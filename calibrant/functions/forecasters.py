"""Forecasters: a registry of functions from an array of the past to a point forecast and a quantile grid by step.

Foundation models need weights that aren't here; the SQL baselines keep the contract. A new forecaster is a function
of (past, horizon) Columns registered under a name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.functions.stats import FIELDS, LEVELS, linear_percentile, once

Forecast = Callable[[Column, int], Column]
REGISTRY: dict[str, Forecast] = {}
ALIASES = {"naive": "last", "seasonal": "seasonal_naive", "mean": "moving_average"}


def forecaster(name: str) -> Callable[[Forecast], Forecast]:
    def add(f: Forecast) -> Forecast:
        REGISTRY[name] = f
        return f

    return add


def get(name: str) -> Forecast:
    key = name.lower().replace("-", "_")
    key = ALIASES.get(key, key)
    if key not in REGISTRY:
        raise ValueError(f"unknown forecaster: {name}; there are {sorted(REGISTRY)}")
    return REGISTRY[key]


def _around(errors: Column) -> Column:
    """What the quantiles add to the point forecast; the errors are made and sorted once."""
    of = lambda ranked: F.struct(*[F.coalesce(linear_percentile(ranked, t), F.lit(0.0)).alias(f) for t, f in zip(LEVELS, FIELDS)])
    return once(F.sort_array(F.filter(errors, lambda e: e.isNotNull())), of)


def _lagged(past: Column, lag: int) -> Column:
    n = F.size(past) - lag
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(past, i + lag) - F.get(past, i))).otherwise(F.array().cast("array<double>"))


def _steps(horizon: int, point: Callable[[Column], Column], errors: Column) -> Column:
    def of(grid: Column) -> Column:
        each = lambda p: F.struct(*[(p + grid[f]).alias(f) for f in FIELDS])
        return F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda h: F.struct(h.alias("h"), point(h).alias("yhat"), each(point(h)).alias("q")))

    return once(_around(errors), of)


@forecaster("last")
def last(past: Column, horizon: int) -> Column:
    return _steps(horizon, lambda h: F.element_at(past, -1), _lagged(past, 1))


def seasonal(period: int) -> Forecast:
    """Repeat the last period; with less past than that, the last value."""

    def f(past: Column, horizon: int) -> Column:
        n = F.size(past)
        return _steps(horizon, lambda h: F.when(n >= period, F.get(past, n - period + h % period)).otherwise(F.element_at(past, -1)), _lagged(past, period))

    return f


REGISTRY["seasonal_naive"] = seasonal(24)


@forecaster("moving_average")
def moving_average(past: Column, horizon: int) -> Column:
    mean = F.aggregate(past, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))) / F.nullif(F.size(past), F.lit(0))
    return once(mean, lambda m: _steps(horizon, lambda h: m, F.transform(past, lambda v: v - m)))


@forecaster("drift")
def drift(past: Column, horizon: int) -> Column:
    n = F.size(past)
    slope = (F.element_at(past, -1) - F.get(past, 0)) / F.nullif(n - 1, F.lit(0))
    return once(slope, lambda b: _steps(horizon, lambda h: F.element_at(past, -1) + (h + 1) * F.coalesce(b, F.lit(0.0)), F.transform(_lagged(past, 1), lambda d: d - b)))


def clamp(q: Column, past: Column) -> Column:
    """Not below 0 where the whole past isn't."""
    return F.when(F.array_min(past) >= 0, F.greatest(q, F.lit(0.0))).otherwise(q)


def predict(contexts: DataFrame, name: str, horizon: int, past: str = "past", non_negative: bool = False) -> DataFrame:
    """contexts with h, yhat and q, a row for each step. non_negative: quantiles aren't below 0 where the past never is."""
    out = contexts.withColumn("__f", F.explode(get(name)(F.col(past), horizon))).select(*contexts.columns, "__f.h", "__f.yhat", "__f.q")
    if non_negative:
        out = out.withColumn("yhat", clamp(F.col("yhat"), F.col(past))).withColumn("q", F.struct(*[clamp(F.col(f"q.{f}"), F.col(past)).alias(f) for f in FIELDS]))
    return out


Model = Callable[[list[np.ndarray], int], tuple[np.ndarray, np.ndarray]]


def predict_with(contexts: DataFrame, model: Model, horizon: int, batch: int = 256, past: str = "past", keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """keys, h, yhat and q by a model of Python: a function from a list of pasts to points (pasts by steps) and quantiles
    (pasts by steps by LEVELS). Pasts come in batches of so many; a batch that doesn't fit in memory is halved."""

    def run(pasts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        try:
            return model(pasts, horizon)
        except MemoryError:
            if len(pasts) == 1:
                raise
            half = len(pasts) // 2
            (a, qa), (b, qb) = run(pasts[:half]), run(pasts[half:])
            return np.concatenate([a, b]), np.concatenate([qa, qb])

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                points, grid = run([np.asarray(x, float) for x in part[past]])
                made = {k: np.repeat(part[k].to_numpy(), horizon) for k in keys}
                made |= {"h": np.tile(np.arange(horizon, dtype=np.int32), len(part)), "yhat": points.reshape(-1)}
                yield pd.DataFrame(made | {f: grid.reshape(-1, len(FIELDS))[:, j] for j, f in enumerate(FIELDS)})

    types = dict(contexts.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["h int", "yhat double"] + [f"{f} double" for f in FIELDS])
    got = contexts.select(*keys, past).mapInPandas(each, schema)
    return got.select(*keys, "h", "yhat", F.struct(*FIELDS).alias("q"))


def seasonal_scale(past: Column, period: int) -> Column:
    """Mean absolute seasonal difference of a past; null where it is too short or constant."""
    gaps = _lagged(past, period)
    total = F.aggregate(gaps, F.lit(0.0), lambda s, d: s + F.coalesce(F.abs(d), F.lit(0.0)))
    return F.nullif(total / F.nullif(F.size(gaps), F.lit(0)), F.lit(0.0))


def error_metrics(rows: DataFrame, by: list[str], scale: str | None = None) -> DataFrame:
    """wape, and wql: the weighted quantile loss over the grid's levels. With a column of seasonal scales also mase, the
    mean error, and sql, the mean quantile loss, in units of the scale."""
    gap = lambda f: F.col("y") - F.col(f"q.{f}")
    loss = sum((F.greatest(F.lit(t) * gap(f), F.lit(t - 1) * gap(f)) for t, f in zip(LEVELS, FIELDS)), F.lit(0.0)) * 2 / len(LEVELS)
    error = F.abs(F.col("y") - F.col("yhat"))
    total = F.nullif(F.sum(F.abs("y")), F.lit(0.0))
    scaled = [F.avg(error / F.col(scale)).alias("mase"), F.avg(loss / F.col(scale)).alias("sql")] if scale else []
    return rows.groupBy(*by).agg((F.sum(error) / total).alias("wape"), (F.sum(loss) / total).alias("wql"), *scaled)
