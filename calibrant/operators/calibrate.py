"""Calibrators as plans: static, rolling and sequential thresholds.

Each takes rows with keys, w, split and a score column and returns the test rows
with the threshold that holds before their score is seen. A window or one
aggregate by key is all the shuffle they need. Scores that are null aren't in
any state.
"""

from __future__ import annotations

from inspect import signature

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibrant.functions.stats import INF, conformal_quantile, weighted_quantile


def split_cp(rows: DataFrame, keys: list[str], alpha: float | Column, s: str = "s", out: str = "thr", correction: bool = True) -> DataFrame:
    """One threshold per key from its calibration rows; none gives infinity. A window over the key, so that test and
    calibration rows share the shuffle."""
    cal = F.sort_array(F.collect_list(F.when(F.col("split") == "cal", F.col(s))).over(Window.partitionBy(*keys)))
    return rows.withColumn(out, conformal_quantile(cal, alpha, correction)).where("split = 'test'")


def cfrnn(rows: DataFrame, keys: list[str], alpha: float, horizon: int | Column, s: str = "s", out: str = "thr") -> DataFrame:
    """split_cp at alpha / horizon, which may be a column."""
    return split_cp(rows, keys, F.lit(float(alpha)) / horizon, s, out)


def with_past(rows: DataFrame, keys: list[str], order: str, s: str, size: int | None, out: str = "buf") -> DataFrame:
    """out: the last `size` scores before each row (None: all), oldest first. Rows without a score take no place:
    the frame runs over the count of scores, in which they stand half a step after the last score."""
    by_time = Window.partitionBy(*keys).orderBy(order)
    place = F.count(s).over(by_time) * 2 + F.when(F.col(s).isNull(), 1).otherwise(0)
    frame = Window.partitionBy(*keys).orderBy("__place").rangeBetween(Window.unboundedPreceding if size is None else -2 * size, -1)
    return rows.withColumn("__place", place).withColumn(out, F.collect_list(s).over(frame)).drop("__place")


def trailing(rows: DataFrame, keys: list[str], alpha: float, size: int | None = 100, s: str = "s", order: str = "w", correction: bool = False, out: str = "thr") -> DataFrame:
    """Quantile of the scores in the last `size` rows before each (None: all of them)."""
    return with_past(rows, keys, order, s, size).withColumn(out, conformal_quantile(F.sort_array("buf"), alpha, correction)).drop("buf").where("split = 'test'")


def weighted(rows: DataFrame, keys: list[str], alpha: float, size: int = 100, decay: float = 0.99, test_weight: float = 1.0, weights: tuple[float, ...] | None = None, s: str = "s", order: str = "w", out: str = "thr") -> DataFrame:
    """Quantile of the last `size` scores with weights decay ** age, or with the given ones, the newest score's last."""
    return with_past(rows, keys, order, s, size).withColumn(out, weighted_quantile(F.col("buf"), 1 - alpha, decay, test_weight, weights)).drop("buf").where("split = 'test'")


def _sequence(rows: DataFrame, keys: list[str], order: str, fields: list[Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("t"), *fields))).alias("steps"))


def _folded(keys: list[str], folded: DataFrame) -> DataFrame:
    """Rows of a fold's output array: t and the fold's columns, carried ones among them, so nothing is joined back."""
    return folded.select(*keys, F.explode("out").alias("o")).select(*keys, "o.*")


def aci(rows: DataFrame, keys: list[str], alpha: float, gamma: float = 0.005, size: int = 100, s: str = "s", order: str = "w", carry: tuple[str, ...] = (), correction: bool = True, min_guard: bool = False) -> DataFrame:
    """Adaptive conformal inference: keys, order, carried columns, s, thr and alpha_t of test rows.

    alpha_t starts at alpha and moves by gamma * (alpha - missed), within 0 and 1. The trailing scores depend on
    scores alone, so a window gives them and the fold's state is one number. For sequences of some hundreds of steps
    a key; longer ones belong in the grouped kernel (operators.kernels).
    """
    rows = with_past(rows, keys, order, s, size).withColumn("buf", F.sort_array("buf")).where("split = 'test'")
    fields = [F.col(s).alias("s"), F.col("buf"), *[F.col(c) for c in carry]]
    seq = _sequence(rows, keys, order, fields)
    types = dict(rows.dtypes)
    shape = f"struct<t:{types[order]},s:double,thr:double,alpha_t:double" + "".join(f",{c}:{types[c]}" for c in carry) + ">"

    def step(acc: Column, x: Column) -> Column:
        a = acc["a"]
        q = conformal_quantile(x["buf"], a, correction, min_guard)
        made = F.struct(x["t"].alias("t"), x["s"].alias("s"), q.alias("thr"), a.alias("alpha_t"), *[x[c].alias(c) for c in carry])
        moved = F.least(F.greatest(a + gamma * (alpha - F.when(x["s"] > q, 1.0).otherwise(0.0)), F.lit(0.0)), F.lit(1.0))
        return F.struct(F.when(x["s"].isNull(), a).otherwise(moved).alias("a"), F.concat(acc["out"], F.array(made)).alias("out"))

    start = F.struct(F.lit(float(alpha)).alias("a"), F.array().cast(f"array<{shape}>").alias("out"))
    return _folded(keys, seq.withColumn("out", F.aggregate("steps", start, step, lambda acc: acc["out"]))).withColumnRenamed("t", order)


def pid(rows: DataFrame, keys: list[str], alpha: float, lr: float = 0.1, ki: float = 0.0, c_sat: float = 1.0, size: int = 100, proportional: bool = True, s: str = "s", order: str = "w", carry: tuple[str, ...] = ()) -> DataFrame:
    """Quantile tracking with an integrator: keys, order, carried columns, s and thr of test rows.

    The threshold starts at the calibration quantile (infinity: the largest score), falls by the rate times alpha
    when covered and rises by the rate times 1 - alpha when not; the rate follows the range of the trailing scores.
    ki adds the saturation term of the running error count.
    """
    all_cal = F.sort_array(F.collect_list(F.when(F.col("split") == "cal", F.col(s))).over(Window.partitionBy(*keys)))
    spread = F.when(F.size("buf") > 0, F.array_max("buf") - F.array_min("buf")) if proportional else F.lit(None).cast("double")
    rows = with_past(rows.withColumn("q0", conformal_quantile(all_cal, alpha)), keys, order, s, size).withColumn("spread", spread).where("split = 'test'")
    seq = _sequence(rows, keys, order, [F.col(s).alias("s"), F.col("spread"), F.col("q0"), *[F.col(c) for c in carry]])
    types = dict(rows.dtypes)
    shape = f"struct<t:{types[order]},s:double,thr:double" + "".join(f",{c}:{types[c]}" for c in carry) + ">"

    def step(acc: Column, x: Column) -> Column:
        missed = F.when(x["s"] > acc["q"], 1.0).otherwise(0.0)
        rate = F.lit(float(lr)) * F.coalesce(x["spread"], F.lit(1.0))
        integral = F.lit(0.0)
        if ki:
            angle = (acc["e"] - acc["n"] * alpha) * F.log(acc["n"] + 1) / (c_sat * (acc["n"] + 1))
            integral = F.when(F.abs(angle) < 1.5707963267948966, ki * F.tan(angle)).otherwise(0.0)
        qt = acc["qt"] - rate * (alpha - missed)
        made = F.struct(x["t"].alias("t"), x["s"].alias("s"), acc["q"].alias("thr"), *[x[c].alias(c) for c in carry])
        keep = x["s"].isNull()
        new = lambda old, value: F.when(keep, acc[old]).otherwise(value).alias(old)
        return F.struct(new("qt", qt), new("q", qt + integral), new("e", acc["e"] + missed), new("n", acc["n"] + 1), F.concat(acc["out"], F.array(made)).alias("out"))

    q0 = F.get("steps", 0)["q0"]
    q0 = F.when(q0 < F.lit(INF), q0).otherwise(0.0)
    start = F.struct(q0.alias("qt"), q0.alias("q"), F.lit(0.0).alias("e"), F.lit(0.0).alias("n"), F.array().cast(f"array<{shape}>").alias("out"))
    return _folded(keys, seq.withColumn("out", F.aggregate("steps", start, step, lambda acc: acc["out"]))).withColumnRenamed("t", order)


def both_tails(calibrator, rows: DataFrame, keys: list[str], alpha: float, carry: tuple[str, ...] = (), order: str = "w", **options) -> DataFrame:
    """Asymmetric calibration: the calibrator at alpha / 2 for each tail, both through one shuffle as rows of a longer
    key. Returns keys, order, carried columns, q_lo and q_up of the test rows."""
    tails = F.explode(F.array(F.struct(F.lit("lo").alias("tail"), F.col("s_lo").alias("s")), F.struct(F.lit("up").alias("tail"), F.col("s_up").alias("s"))))
    long = rows.select(*keys, order, "split", *carry, tails.alias("x")).select(*keys, order, "split", *carry, "x.tail", "x.s")
    takes = signature(calibrator).parameters
    options |= {k: v for k, v in (("carry", carry), ("order", order)) if k in takes}
    thr = calibrator(long, [*keys, "tail"], alpha / 2, **options)
    pick = lambda t: F.max(F.when(F.col("tail") == t, F.col("thr")))
    return thr.groupBy(*keys, order).agg(pick("lo").alias("q_lo"), pick("up").alias("q_up"), *[F.first(c).alias(c) for c in carry])


def single_step(rows: DataFrame, keys: list[str], alpha: float, horizon: int, online: bool, gamma: float = 0.005, size: int = 100, s: str = "s") -> DataFrame:
    """One ACI state per key over the flattened sequence w * horizon + h: keys, w, h, s, thr.

    online: every step sees the one before. Otherwise a window's threshold is frozen before its first step, and the
    state then takes all its steps' scores against that threshold.
    """
    flat = rows.withColumn("pos", F.col("w") * horizon + F.col("h"))
    if online:
        out = aci(flat, keys, alpha, gamma, size, s, "pos", carry=("w", "h"))
        return out.select(*keys, "w", "h", "s", "thr")
    flat = with_past(flat, keys, "pos", s, size)
    step0 = F.sort_array(F.first(F.when(F.col("h") == 0, F.col("buf")), ignorenulls=True).over(Window.partitionBy(*keys, "w")))
    per = flat.withColumn("buf", step0).where("split = 'test'").groupBy(*keys, "w").agg(F.first("buf").alias("buf"), F.sort_array(F.collect_list(F.struct("h", F.col(s).alias("s")))).alias("xs"))
    seq = per.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("w", "buf", "xs"))).alias("steps"))
    shape = "struct<w:int,thr:double,xs:array<struct<h:int,s:double>>>"

    def step(acc: Column, x: Column) -> Column:
        q = conformal_quantile(x["buf"], acc["a"])
        move = lambda a, e: F.when(e["s"].isNull(), a).otherwise(F.least(F.greatest(a + gamma * (alpha - F.when(e["s"] > q, 1.0).otherwise(0.0)), F.lit(0.0)), F.lit(1.0)))
        made = F.struct(x["w"].alias("w"), q.alias("thr"), x["xs"].alias("xs"))
        return F.struct(F.aggregate(x["xs"], acc["a"], move).alias("a"), F.concat(acc["out"], F.array(made)).alias("out"))

    start = F.struct(F.lit(float(alpha)).alias("a"), F.array().cast(f"array<{shape}>").alias("out"))
    done = seq.select(*keys, F.explode(F.aggregate("steps", start, step, lambda acc: acc["out"])).alias("o"))
    return done.select(*keys, "o.w", "o.thr", F.explode("o.xs").alias("e")).select(*keys, "w", "e.h", "e.s", "thr")
