"""Conformal forecast analytics on Spark DataFrames.

The names in __all__ are imported when they are first used: an executor's worker that needs one module doesn't load all.
"""

from importlib import import_module

__version__ = "0.2.0"

_FROM = {
    "calibrant.functions.forecasters": ("forecaster", "predict", "predict_with"),
    "calibrant.functions.scores": ("SCORES", "Score"),
    "calibrant.functions.stats": ("conformal_quantile", "weighted_quantile"),
    "calibrant.operators.calibrate": ("aci", "cfrnn", "pid", "single_step", "split_cp", "trailing", "weighted"),
    "calibrant.operators.joint": ("cafht", "copula_bisection", "joint_cfrnn", "norm_max"),
    "calibrant.operators.kernels": ("acmcp_bounds", "online", "spci_bounds"),
    "calibrant.operators.metrics": ("by_horizon", "joint_coverage", "marks", "rolling", "scaled", "summary"),
    "calibrant.operators.pooled": ("medians", "order_statistics"),
    "calibrant.operators.ranks": ("past_quantiles",),
    "calibrant.operators.segments": ("scan",),
    "calibrant.plans.cache": ("run_cached",),
    "calibrant.sources.files": ("read_arrow", "read_npz", "write_arrow"),
    "calibrant.streaming.stateful": ("adaptive_levels",),
    "calibrant.plans.evaluate": ("Calibrator", "EvalConfig", "JointCalibrator", "register_calibrator", "register_joint", "run", "run_folds", "run_joint", "run_joint_folds", "run_single_step", "run_sweep", "run_timed"),
}
_HOME = {name: module for module, names in _FROM.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module 'calibrant' has no attribute {name!r}")
    return getattr(import_module(_HOME[name]), name)
