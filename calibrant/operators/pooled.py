"""Exact order statistics of pooled values, without gathering them.

A sketch of each group gives brackets around the wanted ranks; one more pass
counts what lies below a bracket and each value inside it, both combined before
the shuffle, and the rank is found by running counts. Groups are few (steps,
folds, grid points): a row of each is broadcast; their values may be any number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Points of the sketch's grid, and its accuracy: a bracket spans four of the points.
POINTS, ACCURACY = 256, 10_000


def order_statistics(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """by, n, and for each name in ranks the value of that rank (a function of n, counted from 1 and held within 1 and n)
    among the group's values. Nulls don't count; a group without values has no row."""
    own = rows.where(F.col(value).isNotNull()).select(*by, F.lit(0).alias("__g"), F.col(value).alias("v"))
    keys = ["__g", *by]
    sketch = own.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("v", [k / POINTS for k in range(POINTS + 1)], ACCURACY).alias("cuts"))
    held = lambda f: F.least(F.greatest(f(F.col("n")).cast("bigint"), F.lit(1)), F.col("n"))
    places = F.array(*[F.struct(F.lit(name).alias("name"), held(f).alias("rank")) for name, f in ranks.items()])
    under = lambda rank: F.floor((rank - 1) / F.col("n") * POINTS).cast("int") - 1
    over = lambda rank: F.ceil(rank / F.col("n") * POINTS).cast("int") + 1
    wanted = sketch.withColumn("places", F.transform(places, lambda x: F.struct(x["name"].alias("name"), x["rank"].alias("rank"), under(x["rank"]).alias("under"), over(x["rank"]).alias("over"))))
    brackets = F.array_distinct(F.transform("places", lambda x: F.struct(x["under"].alias("under"), x["over"].alias("over"))))
    asked = lambda b: F.transform(F.filter("places", lambda x: (x["under"] == b["under"]) & (x["over"] == b["over"])), lambda x: F.struct(x["name"].alias("name"), x["rank"].alias("rank")))
    wanted = wanted.select(*keys, "n", "cuts", F.inline(F.transform(brackets, lambda b: F.struct(b["under"].alias("under"), b["over"].alias("over"), asked(b).alias("asked")))))
    wanted = wanted.select(*keys, "n", "asked", F.when(F.col("under") > 0, F.get("cuts", "under")).alias("lo"), F.when(F.col("over") < POINTS, F.get("cuts", "over")).alias("hi"))
    near = own.join(F.broadcast(wanted), keys).where("hi IS NULL OR v <= hi").withColumn("v", F.when(F.col("lo").isNull() | (F.col("v") >= F.col("lo")), F.col("v")))
    counts = near.groupBy(*keys, "n", "asked", "v").agg(F.count("*").alias("c"))  # ranks of one bracket share its rows
    run = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys, "asked").orderBy(F.col("v").asc_nulls_first())))
    missed = F.raise_error(F.lit("a sketch's bracket missed its rank"))
    found = run.select(*keys, "n", "v", "upto", F.inline("asked")).where("upto >= rank").groupBy(*keys, "n", "name").agg(F.min(F.when(F.col("v").isNull(), missed).otherwise(F.col("v"))).alias("v"))
    return found.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks]).drop("__g")


def medians(rows: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """by and the median of each of the values (the mean of the middle two)."""
    long = rows.select(*by, F.inline(F.array(*[F.struct(F.lit(name).alias("what"), c.cast("double").alias("x")) for name, c in values.items()])))
    got = order_statistics(long, [*by, "what"], "x", {"a": lambda n: F.floor((n + 1) / 2), "b": lambda n: F.ceil((n + 1) / 2)})
    middle = (F.col("a") + F.col("b")) / 2
    return got.groupBy(*by).agg(*[F.max(F.when(F.col("what") == name, middle)).alias(name) for name in values])
