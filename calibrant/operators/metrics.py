"""Coverage, width and Winkler score of intervals, and their roll-ups.

One policy for every path: a row counts where lo, hi and y are finite; an
infinite interval is left out of all three and shown by frac_infinite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibrant.functions.scores import interval_fields
from calibrant.functions.stats import INF, finite


def marks(rows: DataFrame, alpha: float | Column, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """rows with covered, width and winkler (null where any of lo, hi, y isn't finite) and infinite."""
    a, b, y = finite(lo), finite(hi), finite("y")
    width = b - a
    miss = F.greatest(a - y, y - b, F.lit(0.0))
    ok = a.isNotNull() & b.isNotNull() & y.isNotNull()
    return (
        rows.withColumn("covered", F.when(ok, ((y >= a) & (y <= b)).cast("double")))
        .withColumn("width", F.when(ok, width))
        .withColumn("winkler", F.when(ok, width + (2 / alpha) * miss))
        .withColumn("infinite", (F.abs(F.col(lo)) == F.lit(INF)) | (F.abs(F.col(hi)) == F.lit(INF)))
    )


def native(panel: DataFrame, alpha: float) -> DataFrame:
    """Test rows with the forecast's own interval as lo and hi."""
    lo, hi = interval_fields(alpha)
    return panel.where("split = 'test'").withColumn("lo", F.col(f"q.{lo}")).withColumn("hi", F.col(f"q.{hi}"))


def whole_mean(c: str) -> Column:
    """Mean over series; null if any series has none."""
    return F.when(F.count(c) == F.count("*"), F.avg(c))


def by_horizon(marked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per step h: means over series of each series' mean, and the share of infinite intervals. Two aggregations, the
    first of which combines before the shuffle."""
    by = by or []
    per = marked.groupBy(*by, "series", "h").agg(F.avg("covered").alias("coverage"), F.avg("width").alias("avg_width"), F.avg("winkler").alias("winkler_score"), F.avg(F.col("infinite").cast("double")).alias("frac_infinite"))
    return per.groupBy(*by, "h").agg(*[whole_mean(c).alias(c) for c in ("coverage", "avg_width", "winkler_score")], F.avg("frac_infinite").alias("frac_infinite"))


def joint_coverage(marked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of (series, window) trajectories of which every step is covered; steps that don't count miss."""
    by = by or []
    return marked.groupBy(*by, "series", "w").agg(F.bool_and(F.coalesce(F.col("covered") == 1, F.lit(False))).alias("all")).groupBy(*by).agg(F.avg(F.col("all").cast("double")).alias("joint_coverage"))


def summary(marked: DataFrame, by: list[str]) -> DataFrame:
    """One row per group of by: means over steps of the per-step metrics, and joint coverage. Steps and trajectories are
    two grouping sets of one pass over the rows, so nothing is read twice or joined."""
    named = {"coverage": "covered", "avg_width": "width", "winkler_score": "winkler"}
    all_in = F.bool_and(F.coalesce(F.col("covered") == 1, F.lit(False)))
    sets = [[F.col(c) for c in (*by, "series", "h")], [F.col(c) for c in (*by, "series", "w")]]
    per = marked.groupingSets(sets, *by, "series", "h", "w").agg(F.grouping("h").alias("g"), *[F.avg(c).alias(m) for m, c in named.items()], all_in.alias("all"))
    steps = per.groupBy(*by, "g", "h").agg(*[whole_mean(m).alias(m) for m in named], F.avg(F.col("all").cast("double")).alias("joint"))
    return steps.groupBy(*by).agg(*[F.avg(F.when(F.col("g") == 0, F.col(m))).alias(m) for m in named], F.max(F.when(F.col("g") == 1, F.col("joint"))).alias("joint_coverage"))


def scaled(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """scaled_width and scaled_winkler: divided by those of the row whose method is Native, in each group of by;
    divisors up to 1e-8, or missing, are 1."""
    w = Window.partitionBy(*(by or [F.lit(1)]))

    def base(c: str) -> Column:
        x = F.max(F.when(F.col("method") == "Native", F.col(c))).over(w)
        return F.when(x > 1e-8, x).otherwise(F.lit(1.0))

    return rows.withColumn("scaled_width", F.col("avg_width") / base("avg_width")).withColumn("scaled_winkler", F.col("winkler_score") / base("winkler_score"))


def rolling(marked: DataFrame, keys: list[str], order: str = "w", size: int = 50) -> DataFrame:
    """rolling_coverage and rolling_width: trailing means with the current row."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - size, 0)
    return marked.withColumn("rolling_coverage", F.avg("covered").over(frame)).withColumn("rolling_width", F.avg("width").over(frame))


def burn_in(rows: DataFrame, keys: list[str], first: int, order: str = "w") -> DataFrame:
    """Without the first rows of each key: they have updated states, but don't count."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("__n") > first).drop("__n")
