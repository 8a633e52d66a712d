"""Nonconformity scores and their inversion to intervals, as Column expressions over a panel.

A panel has y, yhat and q, a struct of the nine quantiles q10 to q90; scaled
scores read iqr_floor, rho_mad, sigma_lo and sigma_hi, and diff reads prev.
"""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import Column
from pyspark.sql import functions as F

from calibrant.functions.stats import FIELDS, INF, LEVELS, col, finite, safe_scale

EPS = 1e-6
SCORES = ("abs", "squared", "signed", "iqr_scaled", "mad_scaled", "cqr", "scaled_cqr", "distributional", "cdf_tail", "log", "diff", "joint")
LEGACY = {"residual": "abs", "normalized": "iqr_scaled"}
SYMMETRIC_ONLY = ("distributional", "cdf_tail")


def resolve(name: str) -> str:
    name = LEGACY.get(name, name)
    if name not in SCORES:
        raise ValueError(f"unknown score: {name}")
    return name


def slug(name: str) -> str:
    return name.replace("_", "-")


def check(name: str, asymmetric: bool) -> None:
    """signed needs two thresholds; scores over the whole quantile grid have one."""
    if name == "signed" and not asymmetric:
        raise ValueError("signed scores need asymmetric calibration")
    if name in SYMMETRIC_ONLY and asymmetric:
        raise ValueError(f"{name} scores are symmetric only")


def interval_fields(alpha: float, fields: tuple[str, ...] = FIELDS) -> tuple[str, str]:
    """The quantile fields at alpha / 2 and 1 - alpha / 2; without such levels the lowest and the highest."""
    levels = {f: int(f[1:]) / 100 for f in fields}

    def near(p: float) -> str | None:
        return next((f for f, t in levels.items() if abs(t - p) < 1e-6), None)

    lo, hi = near(alpha / 2), near(1 - alpha / 2)
    return (lo, hi) if lo and hi else (min(levels, key=levels.get), max(levels, key=levels.get))


@dataclass(frozen=True)
class Score:
    """Expressions of one score type at one alpha."""

    name: str
    alpha: float

    @property
    def lo(self) -> Column:
        return F.col(f"q.{interval_fields(self.alpha)[0]}")

    @property
    def hi(self) -> Column:
        return F.col(f"q.{interval_fields(self.alpha)[1]}")

    @property
    def scale(self) -> Column:
        """What abs residuals are divided by."""
        if self.name == "iqr_scaled":
            return safe_scale(self.hi - self.lo, "iqr_floor")
        return F.col("rho_mad") if self.name == "mad_scaled" else F.lit(1.0)

    def score(self) -> Column:
        """The unsigned score; null where truth or forecast isn't finite."""
        y, p = finite("y"), finite("yhat")
        r = y - p
        match self.name:
            case "abs" | "joint":
                s = F.abs(r)
            case "squared":
                s = r * r
            case "signed":
                s = r
            case "iqr_scaled" | "mad_scaled":
                s = F.abs(r) / self.scale
            case "cqr":
                s = F.greatest(self.lo - y, y - self.hi)
            case "scaled_cqr":
                s = F.greatest((self.lo - y) / F.col("sigma_lo"), (y - self.hi) / F.col("sigma_hi"))
            case "distributional":
                s = excess_pinball(y)
            case "cdf_tail":
                u = cdf_from_grid(y)
                s = F.greatest(F.lit(self.alpha / 2) - u, u - F.lit(1 - self.alpha / 2), F.lit(0.0))
            case "log":
                return F.when((y + EPS > 0) & (p + EPS > 0), F.abs(F.log(y + EPS) - F.log(p + EPS))).when(y.isNotNull() & p.isNotNull(), F.lit(INF))
            case "diff":
                s = F.abs(r - F.col("prev"))
        return F.when(y.isNotNull() & p.isNotNull(), s)

    def tails(self) -> tuple[Column, Column]:
        """Signed scores of the lower and the upper tail, for asymmetric calibration."""
        check(self.name, True)
        y, p = finite("y"), finite("yhat")
        match self.name:
            case "cqr":
                return self.lo - y, y - self.hi
            case "scaled_cqr":
                return (self.lo - y) / F.col("sigma_lo"), (y - self.hi) / F.col("sigma_hi")
            case "log":
                e = F.when((y + EPS > 0) & (p + EPS > 0), F.log(y + EPS) - F.log(p + EPS))
            case "diff":
                e = y - p - F.col("prev")
            case "iqr_scaled" | "mad_scaled":
                e = (y - p) / self.scale
            case _:
                e = y - p
        return -e, e

    def bounds(self, q_lo: Column | str, q_up: Column | str, asymmetric: bool = False) -> tuple[Column, Column]:
        """The interval for thresholds q_lo and q_up (the same for symmetric calibration)."""
        a, b, p = col(q_lo), col(q_up), F.col("yhat")
        match self.name:
            case "squared" if not asymmetric:
                return p - F.sqrt(F.greatest(a, F.lit(0.0))), p + F.sqrt(F.greatest(b, F.lit(0.0)))
            case "iqr_scaled" | "mad_scaled":
                return p - a * self.scale, p + b * self.scale
            case "cqr":
                return self.lo - a, self.hi + b
            case "scaled_cqr":
                return self.lo - a * F.col("sigma_lo"), self.hi + b * F.col("sigma_hi")
            case "distributional":
                return invert_distributional(b)
            case "cdf_tail":
                return quantile_from_grid(F.greatest(F.lit(0.0), self.alpha / 2 - b)), quantile_from_grid(F.least(F.lit(1.0), 1 - self.alpha / 2 + b))
            case "log":
                center = F.log(p + EPS)
                return F.exp(center - a) - EPS, F.exp(center + b) - EPS
            case "diff":
                center = p + F.col("prev")
                return center - a, center + b
        return p - a, p + b


def _once(values: Column, f) -> Column:
    """f of an array that is made once, however often f reads it."""
    return F.get(F.transform(F.array(values), lambda a: f([F.get(a, k) for k in range(len(FIELDS))])), 0)


def _knots() -> Column:
    """The grid's quantiles in ascending order; null if one is missing."""
    qs = F.array(*[F.col(f"q.{f}") for f in FIELDS])
    return F.when(~F.exists(qs, lambda x: x.isNull()), F.sort_array(qs))


#: Slope of the mean pinball loss where so many of the knots lie below: each one passed adds 1 to the sum of levels less 1.
SLOPES = [round(sum(LEVELS) - len(LEVELS) + j, 9) / len(LEVELS) for j in range(len(LEVELS) + 1)]
#: The knot at which the slope turns: the loss is least there.
LOWEST = next(j for j, x in enumerate(SLOPES) if x > 0) - 1


def _rises(m: list[Column]) -> list[Column]:
    """What the loss is over its least at each knot, along the segments between them."""
    out = {LOWEST: F.lit(0.0)}
    for k in range(LOWEST + 1, len(m)):
        out[k] = out[k - 1] + SLOPES[k] * (m[k] - m[k - 1])
    for k in range(LOWEST - 1, -1, -1):
        out[k] = out[k + 1] - SLOPES[k + 1] * (m[k + 1] - m[k])
    return [out[k] for k in range(len(m))]


def excess_pinball(v: Column) -> Column:
    """Mean over the grid's levels of the pinball loss of v, less the least that any value has. The loss is convex and
    piecewise linear, so it is the largest of its support lines."""

    def of(m: list[Column]) -> Column:
        rise = _rises(m)
        right = [rise[k] + SLOPES[k + 1] * (v - m[k]) for k in range(LOWEST, len(m))]
        left = [rise[k] + SLOPES[k] * (v - m[k]) for k in range(LOWEST + 1)]
        return F.greatest(*right, *left)

    return F.when(v.isNotNull(), _once(_knots(), of))


def invert_distributional(threshold: Column) -> tuple[Column, Column]:
    """Where the mean pinball loss is its least plus threshold: the nearest of the support lines' points on either side.
    A threshold under 0 gives the minimiser, an infinite one no bounds."""
    t, bound = F.greatest(threshold, F.lit(0.0)), threshold < F.lit(INF)
    right = _once(_knots(), lambda m: F.least(*[m[k] + (t - r) / SLOPES[k + 1] for k, r in enumerate(_rises(m)) if k >= LOWEST]))
    left = _once(_knots(), lambda m: F.greatest(*[m[k] + (t - r) / SLOPES[k] for k, r in enumerate(_rises(m)) if k <= LOWEST]))
    return F.when(bound, left).otherwise(F.lit(-INF)), F.when(bound, right).otherwise(F.lit(INF))


def _monotone() -> Column:
    """The grid's running maximum: crossed quantiles in order."""
    qs = [F.col(f"q.{f}") for f in FIELDS]
    return F.array(qs[0], *[F.greatest(*qs[: k + 1]) for k in range(1, len(qs))])


def cdf_from_grid(y: Column) -> Column:
    """Distribution function of the grid at y: linear inside, the end slopes carried on outside, within [0, 1]."""
    t, last = LEVELS, len(LEVELS) - 1

    def of(m: list[Column]) -> Column:
        width = lambda a, b: F.greatest(m[b] - m[a], F.lit(1e-8))
        under = F.least(F.greatest(t[0] + (t[1] - t[0]) / width(0, 1) * (y - m[0]), F.lit(0.0)), F.lit(t[0]))
        over = F.least(F.greatest(t[last] + (t[last] - t[last - 1]) / width(last - 1, last) * (y - m[last]), F.lit(t[last])), F.lit(1.0))
        u = F.when(y == m[last], F.lit(t[last])).when(y > m[last], over)
        for k in range(last - 1, -1, -1):  # of equal knots the highest level counts
            u = u.when(y == m[k], F.lit(t[k])).when(y > m[k], t[k] + (t[k + 1] - t[k]) * (y - m[k]) / width(k, k + 1))
        return u.when(y.isNotNull(), under)

    return _once(_monotone(), of)


def quantile_from_grid(p: Column) -> Column:
    """Quantile of the grid at probability p: linear inside, the end slopes carried on outside without a limit."""
    t, last = LEVELS, len(LEVELS) - 1

    def of(m: list[Column]) -> Column:
        line = lambda a, b: m[a] + (m[b] - m[a]) * (p - t[a]) / (t[b] - t[a])
        x = F.when(p >= t[last], m[last] + (m[last] - m[last - 1]) * (p - t[last]) / (t[last] - t[last - 1]))
        for k in range(last - 1, -1, -1):
            x = x.when(p == t[k], m[k]).when(p > t[k], line(k, k + 1))
        return x.when(p.isNotNull(), line(0, 1))

    return _once(_monotone(), of)
