"""Per-horizon scales and per-series lags that scores need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibrant.functions.scores import EPS, Score, interval_fields
from calibrant.functions.stats import finite, safe_scale
from calibrant.operators.pooled import medians
from calibrant.sources.shared import stored

MAD = 1.4826  # fixed value: MAD of a normal distribution times this is its standard deviation


def with_prev(panel: DataFrame, keys: list[str]) -> DataFrame:
    """prev: the residual of the window before, same series and step; 0 for the first."""
    before = F.lag(finite("y") - finite("yhat")).over(Window.partitionBy(*keys, "h").orderBy("w"))
    return panel.withColumn("prev", F.coalesce(before, F.lit(0.0)))


def robust_scales(panel: DataFrame, alpha: float, by: list[str] | None = None) -> DataFrame:
    """iqr_floor, rho_mad, sigma_lo and sigma_hi per horizon step (and by), over calibration rows of all series.

    Two passes: medians, then medians of absolute deviations, by distributed order statistics. A scale that isn't over
    1e-8 falls back: the iqr to 1, rho to the iqr, the sigmas to rho. One row per step, so the result is small enough to
    broadcast where the steps are few.
    """
    keys = [*(by or []), "h"]
    lo, hi = (F.col(f"q.{f}") for f in interval_fields(alpha))
    y, p = finite("y"), finite("yhat")
    cal = panel.where("split = 'cal'").select(*keys, F.greatest(hi - lo, F.lit(1e-8)).alias("iqr"), (y - p).alias("r"), (lo - y).alias("a"), (y - hi).alias("b"))
    mid = medians(cal, keys, {"m_iqr": F.col("iqr"), **{f"m_{c}": F.col(c) for c in ("r", "a", "b")}})
    mid = stored(mid, "medians")  # a row per step, read by three plans
    around = cal.join(F.broadcast(mid), keys)
    dev = medians(around, keys, {f"v_{c}": F.abs(F.col(c) - F.col(f"m_{c}")) for c in ("r", "a", "b")})
    dev = mid.select(*keys, F.col("m_iqr").alias("iqr")).join(F.broadcast(dev), keys, "left").withColumns({f"d_{c}": F.col(f"v_{c}") * MAD for c in ("r", "a", "b")})
    floor = safe_scale(F.col("iqr"), 1.0)
    rho = safe_scale(F.col("d_r"), floor)
    return dev.select(*keys, floor.alias("iqr_floor"), rho.alias("rho_mad"), safe_scale(F.col("d_a"), rho).alias("sigma_lo"), safe_scale(F.col("d_b"), rho).alias("sigma_hi"))


def with_scales(panel: DataFrame, alpha: float, by: list[str] | None = None) -> DataFrame:
    panel = stored(panel, "scaled")  # for the passes of the medians
    return panel.join(F.broadcast(robust_scales(panel, alpha, by)), [*(by or []), "h"])


def log_falls_back(panel: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per task (by): whether any truth or forecast is too low for log scores, so that abs is used instead."""
    y, p = finite("y"), finite("yhat")
    bad = ((F.col("split") == "cal") & (y + EPS <= 0)) | (F.col("split").isin("cal", "test") & (p + EPS <= 0))
    return panel.groupBy(*(by or [])).agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("fallback"))


def scored(panel: DataFrame, score: str, alpha: float, keys: list[str], asymmetric: bool = False, groups: list[str] | None = None) -> DataFrame:
    """The panel with what the score needs, and s (or s_lo and s_up). groups are columns (task, model) whose scales are
    their own."""
    if score in ("iqr_scaled", "mad_scaled", "scaled_cqr"):
        panel = with_scales(panel, alpha, groups)
    if score == "diff":
        panel = with_prev(panel, keys)
    kind = Score(score, alpha)
    if asymmetric:
        lo, up = kind.tails()
        return panel.withColumn("s_lo", finite(lo)).withColumn("s_up", finite(up))
    return panel.withColumn("s", finite(kind.score()))
