"""Evaluation plans: panel -> scores -> thresholds -> intervals -> metrics -> summary, for several methods at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from time import perf_counter
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from calibrant.functions.scores import Score, check, interval_fields, resolve
from calibrant.functions.stats import conformal_quantile, finite, weighted_quantile
from calibrant.operators import calibrate as cp
from calibrant.operators import copula as cl
from calibrant.operators import folds as fd
from calibrant.operators import joint as jp
from calibrant.operators import kernels as kn
from calibrant.operators import metrics as mt
from calibrant.operators import scales as sc
from calibrant.operators import segments as sg
from calibrant.sources.shared import stored


@dataclass(frozen=True)
class EvalConfig:
    """What to evaluate; checked when it is made."""

    alpha: float = 0.2
    score: str = "abs"
    methods: tuple[str, ...] = ("SplitCP", "TrailingWindow", "WeightedCP", "ACI", "PID")
    asymmetric: bool = False
    window: int = 100
    options: dict[str, dict] = field(default_factory=dict)
    min_cal_windows: int = 1
    cal_windows: int = -1

    def __post_init__(self) -> None:
        if not 0 < self.alpha < 1:
            raise ValueError("alpha must lie between 0 and 1")
        object.__setattr__(self, "score", resolve(self.score))
        if self.score == "signed" and not self.asymmetric:
            object.__setattr__(self, "asymmetric", True)
        check(self.score, self.asymmetric)
        classify(self.methods)
        if self.asymmetric and (bad := set(self.methods) & {"CFRNN"}):
            raise ValueError(f"symmetric only: {sorted(bad)}")

    def active_cal_windows(self, there: int) -> int | None:
        """Calibration windows to use of those there are; None if they are too few."""
        if there < self.min_cal_windows:
            return None
        return there if self.cal_windows == -1 else min(there, self.cal_windows)


class Calibrator(Protocol):
    """Thresholds of one key's scores: from rows (keys, order, split, s, ..) the test rows with thr, each of which knows
    only scores before it. Options are keywords; `order` names the column of time."""

    def __call__(self, rows: DataFrame, keys: list[str], alpha: float, **options) -> DataFrame: ...


class JointCalibrator(Protocol):
    """Radii under which a trajectory's steps hold at once, of each group of by: from a panel (by, h, radius), or (by,
    series, w, h, radius)."""

    def __call__(self, panel: DataFrame, alpha: float, by: tuple[str, ...], **options) -> DataFrame: ...


@dataclass(frozen=True)
class Method:
    """A calibrator, whether it learns while testing, and what of rows it needs told: the window's size, the columns to
    carry through."""

    thresholds: Calibrator
    online: bool
    sized: bool = True
    carries: bool = False


#: Methods with a threshold per series and step.
MARGINAL: dict[str, Method] = {
    "SplitCP": Method(cp.split_cp, False, sized=False),
    "CFRNN": Method(cp.cfrnn, False, sized=False),
    "TrailingWindow": Method(cp.trailing, True),
    "WeightedCP": Method(cp.weighted, True),
    "CQR": Method(cp.trailing, True),
    "ACI": Method(cp.aci, True, carries=True),
    "PID": Method(cp.pid, True, carries=True),
}
KERNELS = ("AgACI", "DtACI", "AcMCP", "SPCI")
#: Joint methods; those of one radius a step, but for CAFHT's, which follow the trajectory.
JOINT: dict[str, JointCalibrator] = {
    "JointCFRNN": lambda panel, alpha, by, **o: jp.joint_cfrnn(panel, alpha, by=by, **o),
    "NormMaxCP": lambda panel, alpha, by, **o: jp.norm_max(panel, alpha, by=by, **o),
    "CAFHT": lambda panel, alpha, by, **o: jp.radii_of(jp.cafht(panel, alpha, path=jp.aci_path, by=by, **o), by),
    "CAFHT_PID": lambda panel, alpha, by, **o: jp.radii_of(jp.cafht(panel, alpha, path=jp.pid_path, by=by, **o), by),
    "CopulaCPTS": lambda panel, alpha, by, **o: jp.copula_bisection(panel, alpha, by=by, **o),
    "CopulaCPTS_Adam": lambda panel, alpha, by, **o: cl.adam_radii(panel, alpha, by, **o),
}
#: Methods that learn along a fold's sequence: how they walk along it.
WALKS: dict[str, tuple[Calibrator, Callable[..., sg.Steps]]] = {
    "TrailingWindow": (cp.trailing, sg.Trailing),
    "CQR": (cp.trailing, sg.Trailing),
    "WeightedCP": (cp.weighted, sg.Weighted),
    "ACI": (cp.aci, sg.Adaptive),
    "PID": (cp.pid, sg.Tracking),
}


def register_calibrator(name: str, thresholds: Calibrator, online: bool = True, sized: bool = False, carries: bool = False) -> None:
    """Make a calibrator of one's own a method of run(), run_folds() and run_single_step()."""
    MARGINAL[name] = Method(thresholds, online, sized, carries)


def register_joint(name: str, radii: JointCalibrator) -> None:
    JOINT[name] = radii


def online_methods() -> set[str]:
    return {n for n, m in MARGINAL.items() if m.online} | {*KERNELS}


def classify(methods: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """(marginal, joint) methods; an unknown name raises."""
    unknown = [m for m in methods if m not in MARGINAL and m not in KERNELS and m not in JOINT]
    if unknown:
        raise ValueError(f"unknown methods: {unknown}")
    return [m for m in methods if m not in JOINT], [m for m in methods if m in JOINT]


def eligible(panel: DataFrame, config: EvalConfig, groups: list[str]) -> DataFrame:
    """Without the groups (tasks) that have too few calibration windows; of more than are asked for the last ones stay."""
    if config.cal_windows == -1 and config.min_cal_windows <= 1:
        return panel
    marked = panel.withColumn("__all", F.lit(0))
    by = ["__all", *groups]
    cal = F.when(F.col("split") == "cal", F.col("w"))
    there = marked.groupBy(*by).agg(F.countDistinct(cal).alias("__there"), (F.max(cal) + 1).alias("__end")).where(F.col("__there") >= config.min_cal_windows)
    kept = marked.join(F.broadcast(there), by)
    if config.cal_windows != -1:
        kept = kept.withColumn("split", F.when((F.col("split") == "cal") & (F.col("w") < F.col("__end") - config.cal_windows), "skip").otherwise(F.col("split")))
    return kept.drop("__all", "__there", "__end")


def unique_steps(panel: DataFrame, keys: list[str]) -> DataFrame:
    """panel, in which a repeated (keys, w, h) fails the query: two models' or tasks' rows of one series have met. The
    window is that of the calibrators, so it adds no shuffle."""
    before = F.lag("w").over(Window.partitionBy(*keys, "h").orderBy("w"))
    stop = F.raise_error(F.lit(f"rows of {', '.join(keys)} repeat a window and step: name more keys"))
    return panel.withColumn("__before", before).where(F.when(F.col("__before") == F.col("w"), stop).otherwise(F.lit(True))).drop("__before")


def prepared(panel: DataFrame, config: EvalConfig, keys: list[str]) -> list[tuple[DataFrame, EvalConfig]]:
    """What a runner has to run: the eligible groups' rows, and of log scores those of groups whose values are too low by
    abs. A part of several groups may be empty."""
    groups = [k for k in keys if k != "series"]
    panel = unique_steps(eligible(panel, config, groups), keys)
    if config.score != "log":
        return [(panel, config)]
    low = sc.log_falls_back(panel, groups).where("fallback").select(*groups, F.lit(True).alias("__low"))
    instead = replace(config, score="abs")
    if not groups:
        return [(panel, instead if low.count() else config)]
    marked = panel.join(F.broadcast(low), groups, "left")
    return [(marked.where("__low").drop("__low"), instead), (marked.where("__low IS NULL").drop("__low"), config)]


def by_part(panel: DataFrame, config: EvalConfig, keys: tuple[str, ...], run: Callable[[DataFrame, EvalConfig, list[str]], DataFrame]) -> DataFrame:
    """run() of every part of prepared()."""
    made = [run(part, own, [*keys]) for part, own in prepared(panel, config, [*keys])]
    return made[0] if len(made) == 1 else made[0].union(made[1])


def horizons(rows: DataFrame, panel: DataFrame, groups: list[str]) -> DataFrame:
    """rows with __horizon, the number of steps of their group."""
    return jp.beside(rows, panel.groupBy(*groups).agg((F.max("h") + 1).alias("__horizon")), groups)


def intervals(rows: DataFrame, config: EvalConfig, name: str, by: list[str], horizon: Column | int | None = None, order: str = "w") -> DataFrame:
    """Test rows of scored rows with lo and hi by one marginal method that isn't a kernel; by are its keys."""
    method, kind = MARGINAL[name], Score(config.score, config.alpha)
    options = {**({"size": config.window} if method.sized else {}), **config.options.get(name, {})}
    if method.online:
        options["order"] = order
    if method.thresholds is cp.cfrnn:
        options.setdefault("horizon", horizon)
    carry = tuple(c for c in rows.columns if c not in (*by, order, "split", "s", "s_lo", "s_up"))
    if config.asymmetric:
        options.pop("order", None)
        made = cp.both_tails(method.thresholds, rows, by, config.alpha, carry=carry, order=order, **options)
        lo, hi = kind.bounds("q_lo", "q_up", True)
    else:
        made = method.thresholds(rows, by, config.alpha, **options, **({"carry": carry} if method.carries else {}))
        lo, hi = kind.bounds("thr", "thr")
    return made.withColumn("lo", lo).withColumn("hi", hi)


def run(panel: DataFrame, config: EvalConfig, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Summary of each marginal method and Native: coverage, joint_coverage, avg_width, winkler_score, scaled.

    keys name a series; all but "series" (such as task and model) are groups, of which each has its own scales, its own
    row for each method, and its own Native to scale by. Each method is one shuffle by (keys, h); the kernels that
    follow a threshold share one pass. A group whose values are too low for log scores is scored by abs instead.
    """
    return by_part(panel, config, keys, _run)


def _run(panel: DataFrame, config: EvalConfig, keys: list[str]) -> DataFrame:
    return summarised(every_interval(panel, config, keys), config.alpha, keys)


def summarised(rows: DataFrame, alpha: float, keys: list[str]) -> DataFrame:
    """The summary of rows with method, lo and hi, scaled by each group's Native."""
    groups = [k for k in keys if k != "series"]
    return mt.scaled(mt.summary(mt.marks(rows, alpha), [*groups, "method"]), groups)


def every_interval(panel: DataFrame, config: EvalConfig, keys: list[str], native: bool = True) -> DataFrame:
    """keys, w, h, y, lo, hi and method of the test rows by Native and each marginal method. Without native the rows of
    Native aren't made, rather than filtered away: a filter over them would be pushed into what makes them."""
    by, groups = [*keys, "h"], [k for k in keys if k != "series"]
    names = classify(config.methods)[0]
    rows = sc.scored(panel, config.score, config.alpha, keys, config.asymmetric, groups)
    horizon = None
    if "CFRNN" in names and "horizon" not in config.options.get("CFRNN", {}):
        rows, horizon = horizons(rows, panel, groups), F.col("__horizon")
    if {*KERNELS} & {*names}:
        rows = stored(rows, "scored")  # a pass for each kind of kernel
    own = {n: PAST[n] for n in names if n in PAST and MARGINAL[n].thresholds is PAST[n][0] and not config.asymmetric}
    parts = [*([_at_once(rows, config, own, by, horizon, native)] if own or native else []), *_by_kernels(rows, config, keys)]
    parts += [intervals(rows, config, n, by, horizon).withColumn("method", F.lit(n)) for n in names if n not in KERNELS and n not in own]
    return _all(parts, keys)


def _of_split(row: Past, alpha: float, horizon: Column | None) -> Column:
    return conformal_quantile(row.cal, alpha, row.option("correction", True))


def _of_cfrnn(row: Past, alpha: float, horizon: Column | None) -> Column:
    return conformal_quantile(row.cal, F.lit(float(alpha)) / row.option("horizon", horizon))


def _of_trailing(row: Past, alpha: float, horizon: Column | None) -> Column:
    return conformal_quantile(F.sort_array(row.past), alpha, row.option("correction", False))


def _of_weighted(row: Past, alpha: float, horizon: Column | None) -> Column:
    return weighted_quantile(row.past, 1 - alpha, row.option("decay", 0.99), row.option("test_weight", 1.0), row.option("weights", None))


@dataclass(frozen=True)
class Past:
    """What a test row knows: its key's sorted calibration scores, the trailing scores, and the method's options."""

    cal: Column
    past: Column
    options: dict

    def option(self, name: str, default):
        return self.options.get(name, default)


#: Calibrators whose threshold is an expression of a row's past, which one window over the key gives to all of them.
PAST: dict[str, tuple[Calibrator, Callable[[Past, float, Column | None], Column]]] = {
    "SplitCP": (cp.split_cp, _of_split),
    "CFRNN": (cp.cfrnn, _of_cfrnn),
    "TrailingWindow": (cp.trailing, _of_trailing),
    "CQR": (cp.trailing, _of_trailing),
    "WeightedCP": (cp.weighted, _of_weighted),
}


def _at_once(rows: DataFrame, config: EvalConfig, own: dict, by: list[str], horizon: Column | None, native: bool = True) -> DataFrame:
    """Test rows with method, lo and hi of Native and of all methods in own: one sort of each key serves all of them."""
    kind = Score(config.score, config.alpha)
    options = {n: config.options.get(n, {}) for n in own}
    size = {n: options[n].get("size", config.window) for n in own if MARGINAL[n].sized}
    if {"SplitCP", "CFRNN"} & {*own}:
        rows = rows.withColumn("__cal", F.sort_array(F.collect_list(F.when(F.col("split") == "cal", F.col("s"))).over(Window.partitionBy(*by))))
    for k in dict.fromkeys(size.values()):
        rows = cp.with_past(rows, by, "w", "s", k, f"__past_{k}")
    rows = rows.where("split = 'test'")
    for n, (_, of) in own.items():
        past = Past(F.col("__cal"), F.col(f"__past_{size.get(n)}"), options[n])
        rows = rows.withColumn(f"__thr_{n}", of(past, config.alpha, horizon))
    low, high = interval_fields(config.alpha)
    made = [*([("Native", F.col(f"q.{low}"), F.col(f"q.{high}"))] if native else []), *((n, *kind.bounds(f"__thr_{n}", f"__thr_{n}")) for n in own)]
    pairs = F.array(*[F.struct(F.lit(n).alias("method"), lo.alias("lo"), hi.alias("hi")) for n, lo, hi in made])
    return rows.select(*by, "w", "y", F.inline(pairs))


def _all(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    cols = [*keys, "w", "h", "y", "lo", "hi", "method"]
    every = parts[0].select(*cols)
    for p in parts[1:]:
        every = every.unionByName(p.select(*cols))
    return every


def run_sweep(panel: DataFrame, alphas: tuple[float, ...], scores: tuple[str, ...], config: EvalConfig, keys: tuple[str, ...] = ("series",), windows: tuple[int, ...] | None = None, cal_windows: tuple[int, ...] = (-1,)) -> DataFrame:
    """run() of every combination of alpha, score, trailing window and number of calibration windows (-1: all), in one plan:
    a row for each group of keys, combination and method. alpha, score and methods of config don't count but for
    the methods' names and options.

    The panel is read once but for its scales, if a score needs them. A key is a series' step, alpha and score; its sorted
    calibration scores serve all of its methods, and so does one trailing array for each window. Methods are those whose
    threshold is an expression of the past; Native has no score, so it is told with each. Log scores, whose
    groups may fall back to another, go through run(), and so do scaled ones where calibration windows are left out, for
    their scales then are others."""
    names, groups = classify(config.methods)[0], [k for k in keys if k != "series"]
    if other := [n for n in names if n not in PAST or MARGINAL[n].thresholds is not PAST[n][0]]:
        raise ValueError(f"no sweep for {other}")
    scores = tuple(map(resolve, scores))
    scaled = {*scores} & {"iqr_scaled", "mad_scaled", "scaled_cqr"}
    if bad := {"log", "signed"} & {*scores} | (scaled if {*cal_windows} != {-1} else set()):
        raise ValueError(f"no sweep over {sorted(bad)}")
    windows, by = windows or (config.window,), [*keys, "h"]
    panel = rows = stored(unique_steps(panel, [*keys]), "swept")
    if "diff" in scores:
        rows = sc.with_prev(rows, [*keys])
    rows = rows.select("*", F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha"))
    if scaled:
        scales = [sc.robust_scales(panel, a, groups).withColumn("alpha", F.lit(float(a))) for a in alphas]
        every = scales[0]
        for x in scales[1:]:
            every = every.union(x)
        rows = rows.join(F.broadcast(every), [*groups, "h", "alpha"])

    def chosen(of: Callable[[Score], Column], score: str) -> Column:
        """The expression at the row's alpha."""
        got = F.lit(None).cast("double")
        for a in alphas:
            got = F.when(F.col("alpha") == a, of(Score(score, a))).otherwise(got)
        return got

    rows = rows.select("*", F.inline(F.array(*[F.struct(F.lit(n).alias("score"), finite(chosen(lambda k: k.score(), n)).alias("s")) for n in scores])))
    key, cal = [*by, "alpha", "score"], F.col("split") == "cal"
    rows = jp.beside(rows, panel.groupBy(*groups).agg((F.max("h") + 1).alias("__horizon"), (F.max(F.when(cal, F.col("w"))) + 1).alias("__end")), groups)
    for c in cal_windows:
        own = cal if c == -1 else cal & (F.col("w") >= F.col("__end") - c)
        rows = rows.withColumn(f"__cal_{c}", F.sort_array(F.collect_list(F.when(own, F.col("s"))).over(Window.partitionBy(*key))))
    for w in windows:
        rows = cp.with_past(rows, key, "w", "s", w, f"__past_{w}")
    rows, made = rows.where("split = 'test'"), []
    for c in cal_windows:
        for w in windows:
            told = [F.lit(c).alias("cal_windows"), F.lit(w).alias("window")]
            low, high = ([f(a) for a in alphas] for f in (lambda a: F.col(f"q.{interval_fields(a)[0]}"), lambda a: F.col(f"q.{interval_fields(a)[1]}")))
            pick = lambda each: F.coalesce(*[F.when(F.col("alpha") == a, x) for a, x in zip(alphas, each)])
            made.append(F.struct(*told, F.lit("Native").alias("method"), pick(low).alias("lo"), pick(high).alias("hi")))
            for n in names:
                past = Past(F.col(f"__cal_{c}"), F.col(f"__past_{w}"), config.options.get(n, {}))
                thr = f"__thr_{n}_{c}_{w}"
                rows = rows.withColumn(thr, F.coalesce(*[F.when(F.col("alpha") == a, PAST[n][1](past, a, F.col("__horizon"))) for a in alphas]))
                sides = [F.coalesce(*[F.when(F.col("score") == k, chosen(lambda x, i=i, t=thr: x.bounds(t, t)[i], k)) for k in scores]) for i in (0, 1)]
                made.append(F.struct(*told, F.lit(n).alias("method"), sides[0].alias("lo"), sides[1].alias("hi")))
    each = rows.select(*key, "w", "y", F.inline(F.array(*made)))
    combination = [*groups, "alpha", "score", "cal_windows", "window"]
    return mt.scaled(mt.summary(mt.marks(each, F.col("alpha")), [*combination, "method"]), combination)


def run_timed(panel: DataFrame, config: EvalConfig, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """run(), a method at a time, with the runtime of each in seconds. A method's rows are as many as there are groups."""
    spark, every = panel.sparkSession, None
    for name in ("Native", *classify(config.methods)[0]):
        began = perf_counter()
        got = run(panel, replace(config, methods=() if name == "Native" else (name,)), keys)
        rows = [tuple(r) for r in got.where(F.col("method") == name).collect()]
        took = perf_counter() - began
        made = spark.createDataFrame([(*r, took) for r in rows], T.StructType([*got.schema.fields, T.StructField("runtime", T.DoubleType())]))
        every = made if every is None else every.union(made)
    return every


def _by_kernels(rows: DataFrame, config: EvalConfig, keys: list[str]) -> list[DataFrame]:
    """Test rows with method, lo and hi for the kernel methods of config. AgACI and DtACI take any score; SPCI and
    AcMCP have two tails of their own over the residual."""
    by, alpha = [*keys, "h"], config.alpha
    kind = Score(config.score, alpha)
    carry = tuple(c for c in rows.columns if c not in (*by, "w", "split", "s", "s_lo", "s_up") and (c != "q" or config.score not in ("abs", "squared", "signed", "joint")))
    out = []
    if online := tuple(m for m in config.methods if m in kn.ONLINE):
        options = {m: config.options.get(m, {}) for m in online}
        if config.asymmetric:
            tails = F.inline(F.array(F.struct(F.lit("lo").alias("tail"), F.col("s_lo").alias("s")), F.struct(F.lit("up").alias("tail"), F.col("s_up").alias("s"))))
            long = rows.select(*by, "w", "split", tails)
            thr = kn.online(long, [*by, "tail"], alpha / 2, online, size=config.window, options=options)
            pick = lambda t: F.max(F.when(F.col("tail") == t, F.col("thr")))
            thr = thr.groupBy(*by, "w", "method").agg(pick("lo").alias("q_lo"), pick("up").alias("q_up"))
            thr = rows.where("split = 'test'").join(thr, [*by, "w"])
        else:
            thr = kn.online(rows, by, alpha, online, size=config.window, options=options, carry=carry).withColumn("q_lo", F.col("thr")).withColumn("q_up", F.col("thr"))
        lo, hi = kind.bounds("q_lo", "q_up", config.asymmetric)
        out.append(thr.withColumn("lo", lo).withColumn("hi", hi))
    errors = rows.withColumn("e", F.col("y") - F.col("yhat"))
    if "SPCI" in config.methods:
        got = kn.spci_bounds(errors, by, alpha, carry=carry, **{"w": config.window, **config.options.get("SPCI", {})})
        out.append(got.withColumn("lo", F.col("yhat") + F.col("q_lo")).withColumn("hi", F.col("yhat") + F.col("q_up")).withColumn("method", F.lit("SPCI")))
    if "AcMCP" in config.methods:
        got = kn.acmcp_bounds(errors, keys, alpha, carry=(*carry, "split"), **config.options.get("AcMCP", {})).where("split = 'test'")
        out.append(got.withColumn("lo", F.col("yhat") - F.col("q_lo")).withColumn("hi", F.col("yhat") + F.col("q_up")).withColumn("method", F.lit("AcMCP")))
    return out


def run_joint(panel: DataFrame, config: EvalConfig, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Summary of the joint methods of config, in each group of keys: coverage, joint_coverage, avg_width, winkler_score by
    method. A group's horizon and calibration windows are its own."""
    names = classify(config.methods)[1]
    if not names:
        raise ValueError("no joint method")
    groups = tuple(k for k in keys if k != "series")
    return _run_joint(stored(unique_steps(eligible(panel, config, [*groups]), [*keys]), "joint"), config, names, keys)


def _run_joint(panel: DataFrame, config: EvalConfig, names: list[str], keys: tuple[str, ...]) -> DataFrame:
    """Of a stored panel: each method passes over it several times."""
    groups = tuple(k for k in keys if k != "series")
    parts = [jp.with_radii(panel, JOINT[n](panel, config.alpha, by=groups, **config.options.get(n, {})), groups).withColumn("method", F.lit(n)) for n in names]
    return mt.summary(mt.marks(_all(parts, [*keys]), config.alpha), [*groups, "method"])


def folded(rows: DataFrame, n_folds: int, seed: int = 42, by: tuple[str, ...] = ()) -> DataFrame:
    """Cross-sectional rows for a calibrator of one's own: for each fold its own series' rows as test and all others' as
    calibration, one sequence for each (by, fold, h), in order of window and series (`pos`); calibration comes first."""
    placed = rows.withColumn("own", fd.hash_fold(F.col("series"), n_folds, seed)).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    placed = placed.withColumn("split", F.when(F.col("own") == F.col("fold"), "test").otherwise("cal"))
    return sg.with_place(placed.drop("own"), [*by, "fold", "h"], ["split", "w", "series"], "pos")


def run_folds(panel: DataFrame, config: EvalConfig, n_folds: int, seed: int = 42, strategy: str = "all", keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Cross-sectional cross-validation of the marginal methods and Native: a row for each group of keys, fold and method.
    Every window of a series is tested, with what the other folds' series say. SplitCP and CFRNN pool the others' scores by
    a distributed order statistic; methods that learn walk through the fold's windows and series in order, by segments,
    behind the last scores of the others."""
    return by_part(panel, config, keys, lambda part, own, names: _run_folds(part, own, n_folds, seed, strategy, names))


def _run_folds(panel: DataFrame, config: EvalConfig, n_folds: int, seed: int, strategy: str, keys: list[str]) -> DataFrame:
    groups = tuple(k for k in keys if k != "series")
    chosen = fd.chosen_series(panel, strategy, groups).withColumn("split", F.lit("cal"))
    rows = sc.scored(chosen, config.score, config.alpha, keys, config.asymmetric, [*groups])
    if strategy == "all":
        rows = panel = stored(rows, "scored")  # each method passes over them several times
    rows = horizons(rows, panel, [*groups])
    own = rows.withColumn("fold", fd.hash_fold(F.col("series"), n_folds, seed))
    parts = [mt.native(own.withColumn("split", F.lit("test")), config.alpha).withColumn("method", F.lit("Native"))]
    kind = Score(config.score, config.alpha)
    tails: tuple[str, ...] = ("tail",) if config.asymmetric else ()
    alpha = config.alpha / (2 if tails else 1)
    carry = tuple(c for c in rows.columns if c not in (*keys, "w", "h", "split", "s", "s_lo", "s_up"))
    if tails:
        pair = F.inline(F.array(F.struct(F.lit("lo").alias("tail"), F.col("s_lo").alias("s")), F.struct(F.lit("up").alias("tail"), F.col("s_up").alias("s"))))
        rows = rows.select(*keys, "w", "h", "split", *carry, pair)
    by = (*groups, *tails)
    for name in classify(config.methods)[0]:
        options = config.options.get(name, {})
        if name in KERNELS:
            raise ValueError(f"no cross-validation for {name}")
        if MARGINAL[name].thresholds in (cp.split_cp, cp.cfrnn):
            level = alpha if name == "SplitCP" else F.lit(float(alpha)) / options.get("horizon", F.col("__horizon"))
            made = fd.split_cp_folds(rows, level, n_folds, seed, (*by, *(["__horizon"] if name == "CFRNN" else [])))
        elif name in WALKS and MARGINAL[name].thresholds is WALKS[name][0]:
            options = {"size": config.window, **options}
            given = rows
            if name == "PID":
                given = fd.split_cp_folds(rows, alpha, n_folds, seed, by).withColumnRenamed("thr", "q0").drop("fold")
            sequence = fd.fold_sequences(given, n_folds, seed, options["size"], by)
            made = sg.scan(sequence, [*by, "fold", "h"], WALKS[name][1](alpha, **options), ["split", "w", "series"], extra="q0" if name == "PID" else None, carry=carry)
        else:
            if tails:
                raise ValueError(f"no asymmetric cross-validation for {name}")
            parts.append(intervals(folded(rows, n_folds, seed, groups), config, name, [*groups, "fold", "h"], F.col("__horizon"), "pos").withColumn("method", F.lit(name)))
            continue
        if tails:
            pick = lambda t: F.max(F.when(F.col("tail") == t, F.col("thr")))
            held = [F.first(c).alias(c) for c in carry if c not in groups]
            made = made.groupBy(*keys, "w", "h", "fold").agg(pick("lo").alias("q_lo"), pick("up").alias("q_up"), *held)
        lo, hi = kind.bounds(*(("q_lo", "q_up") if tails else ("thr", "thr")), bool(tails))
        parts.append(made.withColumn("lo", lo).withColumn("hi", hi).withColumn("method", F.lit(name)))
    marked = mt.marks(_all(parts, [*keys, "fold"]), config.alpha)
    return mt.summary(marked, [*groups, "fold", "method"])


def fold_average(rows: DataFrame, by: tuple[str, ...] = ("method",)) -> DataFrame:
    """Means over folds of each metric that rows of folds have."""
    return rows.groupBy(*by).agg(*[F.avg(m).alias(m) for m in ("coverage", "avg_width", "winkler_score", "joint_coverage") if m in rows.columns])


def run_joint_folds(panel: DataFrame, n_folds: int, alpha: float, methods: tuple[str, ...] = ("JointCFRNN",), seed: int = 42, keys: tuple[str, ...] = ("series",), options: dict[str, dict] | None = None) -> DataFrame:
    """Joint methods across series: each fold's trajectories against the other folds' errors; a row for each group of keys,
    fold and method. A fold is a group of the runner, so that one plan serves all of them."""
    fold = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))
    every = stored(unique_steps(panel, [*keys]), "joint").withColumn("__own", fd.hash_fold(F.col("series"), n_folds, seed)).withColumn("fold", fold)
    every = every.withColumn("split", F.when(F.col("__own") == F.col("fold"), "test").otherwise("cal")).drop("__own")
    config = EvalConfig(alpha=alpha, methods=methods, options=options or {})
    names = classify(config.methods)[1]
    if not names:
        raise ValueError("no joint method")
    return _run_joint(every, config, names, (*[k for k in keys if k != "series"], "fold", "series"))


def run_single_step(panel: DataFrame, config: EvalConfig, horizon: int | None = None, online: bool = True, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Marginal methods with one state per series over the steps w * horizon + h (None: as many as the panel has): a row for
    each group of keys and method, as run() has.

    online: every step knows the one before. Otherwise a window's threshold is that of its first step. Methods whose
    threshold is moved by their own misses need a rule of their own for that; ACI has one, others raise."""
    horizon = horizon or panel.agg(F.max("h") + 1).first()[0]
    return by_part(panel, config, keys, lambda part, own, names: _run_single_step(part, own, horizon, online, names))


def _run_single_step(panel: DataFrame, config: EvalConfig, horizon: int, online: bool, keys: list[str]) -> DataFrame:
    groups = [k for k in keys if k != "series"]
    rows = sc.scored(panel, config.score, config.alpha, keys, config.asymmetric, groups).withColumn("pos", F.col("w") * horizon + F.col("h"))
    kind, parts = Score(config.score, config.alpha), [mt.native(panel, config.alpha).withColumn("method", F.lit("Native"))]
    for name in classify(config.methods)[0]:
        if name in KERNELS or not online and name not in ("SplitCP", "CFRNN", "TrailingWindow", "WeightedCP", "ACI") or not online and config.asymmetric:
            raise ValueError(f"no {'online' if online else 'frozen'} single-step run for {name}")
        if name == "ACI" and not online:
            options = {"gamma": 0.005, "size": config.window, **config.options.get(name, {})}
            thr = cp.single_step(rows, keys, config.alpha, horizon, False, **options).select(*keys, "w", "h", "thr")
            lo, hi = kind.bounds("thr", "thr")
            made = rows.where("split = 'test'").join(thr, [*keys, "w", "h"]).withColumn("lo", lo).withColumn("hi", hi)
        else:
            made = intervals(rows, config, name, keys, horizon, "pos")
            if not online:
                lo, hi = kind.bounds("thr", "thr")
                start = F.first(F.when(F.col("h") == 0, F.col("thr")), ignorenulls=True).over(Window.partitionBy(*keys, "w"))
                made = made.withColumn("thr", start).withColumn("lo", lo).withColumn("hi", hi)
        parts.append(made.withColumn("method", F.lit(name)))
    return mt.scaled(mt.summary(mt.marks(_all(parts, keys), config.alpha), [*groups, "method"]), groups)


def results(panel: DataFrame, alpha: float, horizon: int, task: Column | None = None, tasks: int = 4, window: int = 20) -> DataFrame:
    """A result frame as reports read it: (task, model, method, coverage, joint_coverage, avg_width, winkler_score,
    n_series). task says where a row belongs (None: series are dealt by hash); the models are the panel's mean and median
    forecasts. All methods' thresholds come from one sort of each (series, h)."""
    if task is None:
        task = F.concat(F.lit("t"), F.pmod(F.xxhash64("series"), F.lit(tasks)).cast("string"))
    by = Window.partitionBy("series", "h")
    rows = panel.select("series", "w", "h", "y", "yhat", "q", "split", task.alias("task"))
    points = {"mean": F.col("yhat"), "median": F.col("q.q50")}
    for model, p in points.items():
        s = F.abs(F.col("y") - p)
        rows = rows.withColumn(f"cal_{model}", F.sort_array(F.collect_list(F.when(F.col("split") == "cal", s)).over(by)))
        rows = rows.withColumn(f"past_{model}", F.sort_array(F.collect_list(s).over(by.orderBy("w").rowsBetween(-window, -1))))
    rows, made = rows.where("split = 'test'"), []
    for model, p in points.items():
        around = lambda name, q: (name, p - q, p + q)  # noqa: B023, E731
        cal = F.col(f"cal_{model}")
        for name, lo, hi in (
            ("Native", F.col("q.q10"), F.col("q.q90")),
            around("SplitCP", conformal_quantile(cal, alpha)),
            around("CFRNN", conformal_quantile(cal, alpha / horizon)),
            around("TrailingWindow", conformal_quantile(F.col(f"past_{model}"), alpha, False)),
        ):
            made.append(F.struct(F.col("task"), F.lit(model).alias("model"), F.lit(name).alias("method"), lo.alias("lo"), hi.alias("hi")))
    # A generator's own columns: a filter on task, model or method then stays above it, and the grouping is by one set of columns.
    each = mt.marks(rows.select("series", "w", "h", "y", F.inline(F.array(*made))), alpha)
    count = panel.select("series", task.alias("task")).groupBy("task").agg(F.countDistinct("series").alias("n_series"))
    return mt.summary(each, ["task", "model", "method"]).join(F.broadcast(count), "task")
