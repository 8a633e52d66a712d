"""Forecast panels from the test tables: one row per (series, window, horizon step).

A baseline forecaster looks at the last `context` steps before each forecast
origin: the point forecast is their mean, the quantile grid their order
statistics. Windows of `horizon` steps follow each other without overlap, and
only complete ones count. Columns: series, w, h, y, yhat, q (q10 to q90), split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibrant.functions.stats import FIELDS, LEVELS, once, order_stat

USER = {"context": 16, "horizon": 4, "cal": 5}
HOURLY = {"context": 48, "horizon": 24, "cal": 10}
WEEKLY = {"context": 26, "horizon": 4, "cal": 40}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def baseline(values: Column) -> Column:
    """Mean and order statistics of an array of values; nulls are left out."""

    def of(clean: Column) -> Column:
        mean = F.aggregate(clean, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(clean), F.lit(0))
        grid = F.struct(*[order_stat(clean, F.lit(t)).alias(f) for t, f in zip(LEVELS, FIELDS)])
        return F.struct(F.round(mean, 6).alias("yhat"), grid.alias("q"))

    return once(F.sort_array(F.filter(values, lambda v: v.isNotNull())), of)


def split_of(w: Column | str, cal: int, active: int | None = None) -> Column:
    """cal for the last `active` of the first `cal` windows, test after them, skip before."""
    w = F.col(w) if isinstance(w, str) else w
    return F.when(w >= cal, "test").when(w >= cal - (cal if active is None else active), "cal").otherwise("skip")


def windows(steps: DataFrame, context: int, horizon: int, cal: int, active: int | None = None, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """Panel of steps (series, y, which may be null, and the columns of their order within a series). One shuffle by series
    and one sort: a block of `horizon` steps is made at its first one, its past are the blocks before it, and a forecast
    is made once a block, so no row carries a past of its own and no join is needed."""
    by_series = Window.partitionBy("series").orderBy(*order)
    at = F.row_number().over(by_series) - 1 - context
    blocks = steps.select("series", at.alias("at"), F.collect_list(F.struct("y")).over(by_series.rowsBetween(0, horizon - 1)).alias("ys"))
    # the first block ends with the context's first steps, and may begin before the series
    first = F.when(F.col("at") == -context, F.slice("ys", 1, context % horizon or horizon)).otherwise(F.col("ys"))
    blocks = blocks.where(((F.col("at") % horizon) == 0) | (F.col("at") == -context)).select("series", F.floor(F.col("at") / horizon).cast("int").alias("w"), first.alias("ys"))
    before = Window.partitionBy("series").orderBy("w").rowsBetween(-(-(-context // horizon)), -1)
    blocks = blocks.select("series", "w", "ys", F.flatten(F.collect_list("ys").over(before))["y"].alias("past")).where((F.col("w") >= 0) & (F.size("ys") == horizon))
    made = blocks.select("series", "w", "ys", baseline(F.slice("past", -context, context)).alias("f"))
    panel = made.select("series", "w", F.posexplode("ys").alias("h", "step"), "f")
    return panel.select("series", "w", "h", F.col("step.y").alias("y"), "f.yhat", "f.q", split_of("w", cal, active).alias("split"))


def user_panel(spark: SparkSession, sf_dir: str, cal: int = USER["cal"]) -> DataFrame:
    """Many short series: each user's event values in order of time."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("series"), "ts", "event_id", F.col("value").alias("y"))
    return windows(events, USER["context"], USER["horizon"], cal, order=("ts", "event_id"))


def hourly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with missing truth: value by event type and hour, null where an hour has no event."""
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("hour"), F.col("value").cast("decimal(18,6)").alias("v"))
    sums = ev.groupBy("series", "hour").agg(F.sum("v").cast("double").alias("y"))
    span = sums.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    hours = span.select(F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("hour"))
    grid = sums.select("series").distinct().crossJoin(hours)
    steps = grid.join(sums, ["series", "hour"], "left").withColumn("t", F.row_number().over(Window.partitionBy("series").orderBy("hour")))
    return windows(steps.select("series", "t", "y"), HOURLY["context"], HOURLY["horizon"], HOURLY["cal"])


def weekly_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by the supplier's nation and week of shipping, 0 in weeks without any."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.date_trunc("week", "l_shipdate").alias("week"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("v"))
    su = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("series"))
    by_supplier = li.groupBy("l_suppkey", "week").agg(F.sum("v").alias("v"))  # summed before the joins
    sums = by_supplier.join(su, "l_suppkey").groupBy("s_nationkey", "week").agg(F.sum("v").cast("double").alias("y")).join(nation, "s_nationkey")
    span = sums.agg(F.min("week").alias("a"), F.max("week").alias("b"))
    grid = sums.select("series").distinct().crossJoin(span.select(F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("week")))
    steps = grid.join(sums.select("series", "week", "y"), ["series", "week"], "left")
    return steps.select("series", F.row_number().over(Window.partitionBy("series").orderBy("week")).alias("t"), F.coalesce("y", F.lit(0.0)).alias("y"))


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few long series of nations; the flagship panel."""
    return windows(weekly_steps(spark, sf_dir), WEEKLY["context"], WEEKLY["horizon"], WEEKLY["cal"])


PANELS = {"user": user_panel, "hourly": hourly_panel, "weekly": weekly_panel}
