"""python -m calibrant forecast|cp_eval: panels from raw series, and evaluations of stored panels."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.functions import forecasters as fc
from calibrant.functions.scores import SCORES
from calibrant.operators import reports as rp
from calibrant.plans import evaluate as ev
from calibrant.sources import datasets as dt
from calibrant.sources import store
from calibrant.sources.shared import stored

KEYS = ("task", "model", "series")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="calibrant")
    sub = p.add_subparsers(dest="command", required=True)
    f = sub.add_parser("forecast", help="forecast raw series by windows and store the panel")
    f.add_argument("--series", required=True, help="Parquet of item_id and target")
    f.add_argument("--predictions", required=True, help="where the panel goes")
    f.add_argument("--task", default="task")
    f.add_argument("--forecaster", default="seasonal_naive")
    f.add_argument("--horizon", type=int, required=True)
    f.add_argument("--windows", type=int, default=1)
    f.add_argument("--cal-windows", type=int, default=0, help="-1: as many as fit")
    f.add_argument("--context", type=int, default=0, help="0: the whole past")
    f.add_argument("--non-negative", action="store_true")
    c = sub.add_parser("cp_eval", help="calibrate and evaluate a stored panel")
    c.add_argument("--predictions", required=True)
    c.add_argument("--results", required=True)
    c.add_argument("--forecasters", nargs="*")
    c.add_argument("--tasks", nargs="*")
    c.add_argument("--alpha", type=float, nargs="+", default=[0.2])
    c.add_argument("--score-type", nargs="+", choices=SCORES, default=["abs"])
    c.add_argument("--methods", nargs="+", default=["SplitCP", "TrailingWindow", "WeightedCP", "ACI", "PID"])
    c.add_argument("--asymmetric", action="store_true")
    c.add_argument("--window", type=int, default=100)
    c.add_argument("--cal-windows", type=int, nargs="+", default=[-1])
    c.add_argument("--min-cal-windows", type=int, default=1)
    c.add_argument("--single-step", action="store_true")
    c.add_argument("--online", action="store_true")
    c.add_argument("--cross-sectional-cv", type=int, default=0, metavar="FOLDS")
    c.add_argument("--covariate-strategy", choices=("all", "targets_only", "covariates_only"), default="all")
    c.add_argument("--runtime", action="store_true", help="time each method")
    return p


def forecast(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    """The panel (task, model, series, w, h, y, yhat, q, split) as it was stored."""
    rows = dt.extended(spark.read.parquet(o.series), o.horizon, o.windows, o.cal_windows)
    past = dt.truncate(F.col("input"), o.context) if o.context else F.col("input")
    made = fc.predict(rows.select(F.col("item_id").alias("series"), "w", "split", "label", past.alias("past")), o.forecaster, o.horizon, non_negative=o.non_negative)
    panel = made.select(F.lit(o.task).alias("task"), F.lit(o.forecaster).alias("model"), "series", "w", F.col("h").cast("int").alias("h"), F.get("label", F.col("h")).alias("y"), "yhat", "q", "split")
    store.write_panel(panel, o.predictions)
    return store.read_panel(spark, o.predictions)


def cp_eval(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    """Every combination of alpha, score and calibration windows; one result file each, and all of their rows. Methods whose
    thresholds are expressions of the past go through all combinations in one plan."""
    panel = store.read_panel(spark, o.predictions)
    for column, wanted in (("model", o.forecasters), ("task", o.tasks)):
        panel = panel.where(F.col(column).isin(*wanted)) if wanted else panel
    marginal, joint = ev.classify(tuple(o.methods))
    parts = []
    mode = "cv" if o.cross_sectional_cv else "single-step" if o.single_step else "marginal"
    scaled = {"iqr_scaled", "mad_scaled", "scaled_cqr"} & {*o.score_type}
    at_once = mode == "marginal" and not o.runtime and not o.asymmetric and o.min_cal_windows <= 1 and {*marginal} <= {*ev.PAST} and not {"log", "signed"} & {*o.score_type} and not (scaled and {*o.cal_windows} != {-1})
    if at_once:
        swept = stored(ev.run_sweep(panel, tuple(o.alpha), tuple(o.score_type), ev.EvalConfig(methods=tuple(marginal)), KEYS, (o.window,), tuple(o.cal_windows)), "sweep")
    for alpha in o.alpha:
        for score in o.score_type:
            for cal in o.cal_windows:
                config = ev.EvalConfig(alpha=alpha, score=score, methods=tuple(marginal), asymmetric=o.asymmetric, window=o.window, cal_windows=cal, min_cal_windows=o.min_cal_windows)
                if at_once:
                    rows = swept.where((F.col("alpha") == alpha) & (F.col("score") == config.score) & (F.col("cal_windows") == cal)).drop("alpha", "score", "cal_windows", "window")
                elif o.cross_sectional_cv:
                    rows = ev.fold_average(ev.run_folds(panel, config, o.cross_sectional_cv, strategy=o.covariate_strategy, keys=KEYS), ("task", "model", "method"))
                elif o.single_step:
                    rows = ev.run_single_step(panel, config, online=o.online, keys=KEYS)
                else:
                    rows = (ev.run_timed if o.runtime else ev.run)(panel, config, KEYS)
                if joint:
                    rows = rp.union_padded([rows, ev.run_joint(panel, replace(config, score="abs", asymmetric=False, methods=tuple(joint)), KEYS)])
                rows = rp.tidy(rows, {"alpha": alpha, "score": score, "cal_windows": cal, "mode": mode})
                store.write_csv(rows, o.results, store.result_name("cp_summary", alpha, score, cal, mode, o.asymmetric, o.online))
                parts.append(rows)
    return rp.union_padded(parts)


def main(argv: list[str] | None = None) -> int:
    o = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    out = forecast(spark, o) if o.command == "forecast" else cp_eval(spark, o)
    out.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
