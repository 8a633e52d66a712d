"""Order statistics of conformal prediction as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
LEVELS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
FIELDS = tuple(f"q{round(100 * t)}" for t in LEVELS)


def col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def once(values: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f reads it: branches and lambdas share no subexpressions."""
    return F.get(F.transform(F.array(values), f), 0)


def finite(x: Column | str) -> Column:
    """x, or null where it is null, NaN or infinite: what every quantile leaves out."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(INF)), x)


def conformal_level(n: Column, alpha: Column | float) -> Column:
    """min(ceil((n + 1)(1 - alpha)) / n, 1), the corrected level; null for n = 0."""
    a = col(alpha)
    return F.least(F.ceil((n + 1) * (1 - a)).cast("double") / F.nullif(n, F.lit(0)), F.lit(1.0))


def order_stat(sorted_values: Column, level: Column) -> Column:
    """The 'higher' order statistic: entry ceil(level * (n - 1)), counted from 0."""
    n = F.size(sorted_values)
    return F.get(sorted_values, F.ceil(F.least(F.greatest(level, F.lit(0.0)), F.lit(1.0)) * (n - 1)).cast("int"))


def conformal_rank(n: Column, alpha: Column | float, correction: bool = True) -> Column:
    """Place, from 1, of the conformal quantile among n sorted scores."""
    level = conformal_level(n, alpha) if correction else 1 - col(alpha)
    return F.ceil(F.least(F.greatest(level, F.lit(0.0)), F.lit(1.0)) * (n - 1)) + 1


def conformal_quantile(sorted_values: Column, alpha: Column | float, correction: bool = True, min_guard: bool = False) -> Column:
    """Threshold over sorted finite scores: no scores give infinity. alpha may be a column (adaptive methods). min_guard:
    without correction, infinity while there are fewer than 1 / alpha scores too."""
    n = F.size(sorted_values)
    level = conformal_level(n, alpha) if correction else 1 - col(alpha)
    enough = n > 0
    if min_guard and not correction:
        enough = enough & (n >= F.ceil(1 / F.greatest(col(alpha), F.lit(1e-9))))
    return F.when(enough, order_stat(sorted_values, level)).otherwise(F.lit(INF))


def weighted_quantile(values: Column, target: Column | float, decay: float, test_weight: float, weights: tuple[float, ...] | None = None) -> Column:
    """Quantile of values in order of age, the newest last, with weights decay ** age, or the last ones of weights (no
    weight before them): the first sorted value whose cumulative share reaches target, infinity if none does. The unseen
    test point has test_weight."""
    n = F.size(values)
    weigh = lambda age: F.pow(F.lit(float(decay)), age.cast("double"))
    if weights is not None:
        newest_first = F.array(*[F.lit(float(x)) for x in reversed(weights)])
        weigh = lambda age: F.coalesce(F.get(newest_first, age), F.lit(0.0))
    pairs = F.transform(values, lambda v, i: F.struct(v.alias("v"), weigh(n - 1 - i).alias("p")))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x["p"]) + F.lit(float(test_weight))
    start = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("q"))

    def step(acc: Column, x: Column) -> Column:
        c = acc["c"] + x["p"]
        return F.struct(c.alias("c"), F.coalesce(acc["q"], F.when(c >= col(target) * total, x["v"])).alias("q"))

    return F.coalesce(F.aggregate(F.sort_array(pairs), start, step, lambda a: a["q"]), F.lit(INF))


def linear_percentile(sorted_values: Column, p: Column | float) -> Column:
    """Percentile with linear interpolation between neighbours; null without values."""
    at = col(p) * (F.size(sorted_values) - 1)
    lo = F.floor(at).cast("int")
    below, above = F.get(sorted_values, lo), F.get(sorted_values, F.least(lo + 1, F.size(sorted_values) - 1))
    return below + (above - below) * (at - lo)


def safe_scale(scale: Column, fallback: Column | float, eps: float = 1e-8) -> Column:
    """scale if it is finite and over eps, else fallback if that is, else 1."""
    good = lambda x: F.when((finite(x) > eps), x)
    return F.coalesce(good(scale), good(col(fallback)), F.lit(1.0))
