"""Roll-ups of result frames: rows of (task, model, method, score, alpha, ..) with metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = ("coverage", "joint_coverage", "avg_width", "winkler_score")


def horizon_category(h: Column | str) -> Column:
    """short up to 30 steps, medium up to 90, else long."""
    h = F.col(h) if isinstance(h, str) else h
    return F.when(h <= 30, "short").when(h <= 90, "medium").otherwise("long")


def mean_median(rows: DataFrame, by: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Mean and median of each metric that rows have, and n_series summed over tasks (one value a task)."""
    have = [m for m in metrics if m in rows.columns]
    made = [f(m).alias(f"{m}_{n}") for m in have for n, f in (("mean", F.avg), ("median", F.median))]
    if "n_series" in rows.columns:
        first = F.row_number().over(Window.partitionBy(*by, "task").orderBy(F.desc("n_series"))) == 1
        rows = rows.withColumn("__n", F.when(first, F.col("n_series")))
        made.append(F.sum("__n").alias("n_series"))
    return rows.groupBy(*by).agg(*made)


def series_weighted(rows: DataFrame, by: list[str], metrics: tuple[str, ...], weight: str = "n_series") -> DataFrame:
    """Means weighted by the number of series; null metrics count as 0."""
    n = F.col(weight)
    return rows.groupBy(*by).agg(*[(F.sum(F.coalesce(F.col(m), F.lit(0.0)) * n) / F.nullif(F.sum(n), F.lit(0))).alias(m) for m in metrics])


def weighted_median(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The least value at which the running weight reaches half of all; without any weight the plain median."""
    w = Window.partitionBy(*by)
    run = rows.where(F.col(value).isNotNull()).withColumn("run", F.sum(weight).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum(weight).over(w))
    out = F.when(F.max("all") > 0, F.min(F.when(F.col("run") >= F.col("all") / 2, F.col(value)))).otherwise(F.median(value))
    return run.groupBy(*by).agg(out.alias(value))


def best(rows: DataFrame, by: list[str], metric: str = "winkler_score", among: str = "method") -> DataFrame:
    """The entry of least metric in each group; ties: the first name."""
    return rows.groupBy(*by).agg(F.min_by(among, F.struct(metric, among)).alias(among), F.min(metric).alias(metric))


def closest(rows: DataFrame, by: list[str], nominal: float, among: str = "method") -> DataFrame:
    """The entry whose coverage is nearest to nominal; ties: the first name."""
    gap = F.abs(F.col("coverage") - nominal)
    return rows.groupBy(*by).agg(F.min_by(among, F.struct(F.round(gap, 9), among)).alias(among), F.min(gap).alias("gap"))


def top(rows: DataFrame, by: list[str], metric: str, n: int = 5, descending: bool = False, tie: str = "method") -> DataFrame:
    """rank and the first n rows of each group by metric. (A row_number limit, which Spark applies before the shuffle too.)"""
    order = F.col(metric).desc_nulls_last() if descending else F.col(metric).asc_nulls_last()
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, tie))).where(F.col("rank") <= n)


def with_all(rows: DataFrame, each: str, of: str) -> DataFrame:
    """Relational division: rows of those `each` that occur with every value of `of` there is."""
    every = rows.agg(F.countDistinct(of).alias("every"))
    full = rows.groupBy(each).agg(F.countDistinct(of).alias("n")).crossJoin(F.broadcast(every)).where("n = every").select(each)
    return rows.join(full, each, "left_semi")


def normalised_width(rows: DataFrame, task: str = "task") -> DataFrame:
    """width_ratio: avg_width over the mean Native width of the task; null where that is 0 or missing."""
    base = F.avg(F.when(F.col("method") == "Native", F.col("avg_width"))).over(Window.partitionBy(task))
    return rows.withColumn("width_ratio", F.col("avg_width") / F.nullif(base, F.lit(0.0)))


def coverage_deviation(rows: DataFrame, by: list[str], nominal: float, weight: str = "n_series") -> DataFrame:
    n = F.col(weight)
    return rows.groupBy(*by).agg((F.sum(F.abs(F.col("coverage") - nominal) * n) / F.sum(n)).alias("deviation"))


def tidy(rows: DataFrame, constants: dict[str, object] | None = None, digits: int = 3, last: tuple[str, ...] = ("runtime",), drop: tuple[str, ...] = ()) -> DataFrame:
    """Constant columns added, doubles rounded half to even, `last` at the end, `drop` gone."""
    rows = rows.withColumns({k: F.lit(v) for k, v in (constants or {}).items()}).drop(*drop)
    order = [c for c in rows.columns if c not in last] + [c for c in last if c in rows.columns]
    kinds = dict(rows.dtypes)
    return rows.select(*[F.bround(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in order])


def filtered(rows: DataFrame, search: str | None = None, columns: tuple[str, ...] = ("task", "model", "method", "score"), **equal) -> DataFrame:
    """Conjunction of filters: column=value or column=(values), column__le and column__ge bounds, column__like patterns,
    column__there=True (not missing), and a case-insensitive search in any of the columns."""
    for k, v in equal.items():
        name, _, op = k.partition("__")
        c = F.col(name)
        match op:
            case "le":
                rows = rows.where(c <= v)
            case "ge":
                rows = rows.where(c >= v)
            case "like":
                rows = rows.where(c.rlike(v))
            case "there":
                rows = rows.na.drop(subset=[name]) if v else rows.where(c.isNull())
            case _:
                rows = rows.where(c.isin(*v) if isinstance(v, (list, tuple, set)) else c == v)
    if search:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.lower(F.col(c)).contains(search.lower()), F.lit(False))
        rows = rows.where(hit)
    return rows


def page(rows: DataFrame, order: str, number: int, size: int, tie: str) -> DataFrame:
    """Page `number` (from 1) in ascending order, nulls last."""
    return rows.orderBy(F.col(order).asc_nulls_last(), tie).offset((number - 1) * size).limit(size)


def union_padded(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns that one lacks are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def with_metadata(rows: DataFrame, meta: DataFrame, on: str = "task") -> DataFrame:
    """Inner join; columns of meta whose names clash get the suffix _meta."""
    return rows.join(meta.select(on, *[F.col(c).alias(f"{c}_meta" if c in rows.columns else c) for c in meta.columns if c != on]), on)


def prefer_summary(results: DataFrame, summary: DataFrame, on: list[str], columns: tuple[str, ...]) -> DataFrame:
    """results' values where there are any, else those of summary (left join)."""
    other = summary.select(*on, *[F.col(c).alias(f"__{c}") for c in columns])
    return results.join(other, on, "left").withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def totals(rows: DataFrame, by: tuple[str, ...] = ("model", "method"), metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Means for every combination of the dimensions and over them (cube); null stands for all."""
    return rows.cube(*by).agg(*[F.avg(m).alias(m) for m in metrics if m in rows.columns])


def grid(spark, **params) -> DataFrame:
    """Every combination of the parameters' values."""
    out = None
    for k, vs in params.items():
        one = spark.createDataFrame([(v,) for v in dict.fromkeys(vs)], [k])
        out = one if out is None else out.crossJoin(one)
    return out


def native_once(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of each group's Native rows the first in order, and all others."""
    first = F.row_number().over(Window.partitionBy(*by, F.col("method") == "Native").orderBy(*order))
    return rows.withColumn("__n", first).where("method <> 'Native' OR __n = 1").drop("__n")


def runtime_totals(rows: DataFrame, by: tuple[str, ...] = ("method",)) -> DataFrame:
    """Seconds of each group: runtimes add up, where other metrics are averaged."""
    return rows.groupBy(*by).agg(F.sum("runtime").alias("runtime"))


def by_category(rows: DataFrame, tie: list[str], category: str = "horizon_category") -> DataFrame:
    """Rows in descending order of category; within one, in order of the tie columns."""
    return rows.orderBy(F.col(category).desc(), *tie)


def shown(x: Column | str) -> Column:
    """A metric as reports print it: N/A where it is missing, with a power of ten from a million on, in scientific form
    under a hundredth, with three digits under a hundred, else with one."""
    x = F.col(x) if isinstance(x, str) else x
    power = F.floor(F.log10(x)).cast("int")
    mantissa = F.format_string("%.2f", x / F.pow(F.lit(10.0), power))
    return (
        F.when(x.isNull() | F.isnan(x), "N/A")
        .when(x > 1e6, F.concat(mantissa, F.lit(" x 10^"), power.cast("string")))
        .when(x < 0.01, F.format_string("%.3e", x))
        .when(x < 100, F.format_string("%.3f", x))
        .otherwise(F.format_string("%.1f", x))
    )
