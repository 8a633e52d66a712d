"""Cross-sectional calibration: series are dealt into folds; each fold is tested with the others' scores."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibrant.functions.stats import INF, conformal_rank
from calibrant.operators.pooled import order_statistics
from calibrant.sources.shared import stored


def fold_count(cal_windows: int, windows: int, series: int) -> int:
    """Folds so that those left in hold at least cal_windows windows' worth of series: 5 if that is enough."""
    least = ceil(cal_windows / max(1, windows))
    if least >= series:
        return max(2, series)
    needed = ceil(1 / (1 - least / series))
    return max(2, min(5, series) if needed <= 5 else min(needed, series))


def hash_fold(series: Column, folds: int, seed: int = 42) -> Column:
    """A series' fold, from 0: the remainder of a seeded hash. It depends on the name alone, so no one needs to see all
    names, and a series that is added moves no other."""
    digest = F.substring(F.md5(F.concat(series.cast("string"), F.lit(f":{seed}"))), 1, 15)
    return F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.lit(folds)).cast("int")


def for_other_folds(rows: DataFrame, n_folds: int) -> DataFrame:
    """Each row once for every fold but its own, in for_fold."""
    return rows.withColumn("for_fold", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(n_folds - 1)), F.array(F.col("fold")))))


def split_cp_folds(rows: DataFrame, alpha: float | Column, n_folds: int, seed: int = 42, by: tuple[str, ...] = ()) -> DataFrame:
    """rows (by, series, w, h, s, ..) with fold and thr: the conformal quantile of all scores of the step in other folds.
    A score counts for all folds but its own, so one order statistic by (by, fold, h) serves every fold."""
    placed = stored(rows.withColumn("fold", hash_fold(F.col("series"), n_folds, seed)), "folds")
    keys = [*by, "fold", "h"]
    others = for_other_folds(placed.select(*keys, "s"), n_folds).select(*by, F.col("for_fold").alias("fold"), "h", "s")
    thr = order_statistics(others, keys, "s", {"thr": lambda n: conformal_rank(n, alpha)}).drop("n")
    return placed.join(F.broadcast(thr), keys, "left").withColumn("thr", F.coalesce("thr", F.lit(INF)))


def fold_sequences(rows: DataFrame, n_folds: int, seed: int, size: int, by: tuple[str, ...] = ()) -> DataFrame:
    """For each fold the sequence of a method that looks back on `size` scores: the fold's own rows as test, in order of
    split, window and series, behind the last of the other folds' rows as calibration. Rows aren't copied for each fold:
    of the others only those last ones are, which each fold's last ones hold."""
    placed = stored(rows.withColumn("fold", hash_fold(F.col("series"), n_folds, seed)), "folds")
    last = lambda *keys: F.row_number().over(Window.partitionBy(*keys, "h").orderBy(F.desc("w"), F.desc("series"))) <= size
    ends = placed.where(F.col("s").isNotNull()).withColumn("__last", last(*by, "fold")).where("__last").drop("__last")
    halo = for_other_folds(ends, n_folds).withColumn("__last", last(*by, "for_fold")).where("__last").withColumn("fold", F.col("for_fold")).drop("for_fold", "__last")
    return placed.withColumn("split", F.lit("test")).unionByName(halo.withColumn("split", F.lit("cal")))


def chosen_series(panel: DataFrame, strategy: str = "all", by: tuple[str, ...] = ()) -> DataFrame:
    """Series that count, in each group of by: targets_only has those whose name holds "target", or else the first one;
    covariates_only the others; all every one."""
    if strategy == "all":
        return panel
    if strategy not in ("targets_only", "covariates_only"):
        raise ValueError(f"strategy: {strategy}")
    by = [*by]
    names = panel.select(*by, "series").distinct()
    named = F.lower("series").contains("target")
    stats = names.groupBy(*by).agg(F.bool_or(named).alias("has"), F.min("series").alias("first"))
    marked = (names.join(stats, by) if by else names.crossJoin(F.broadcast(stats))).withColumn("is_target", F.when(F.col("has"), named).otherwise(F.col("series") == F.col("first")))
    keep = marked.where("is_target" if strategy == "targets_only" else "NOT is_target").select(*by, "series")
    return panel.join(keep, [*by, "series"], "left_semi")
