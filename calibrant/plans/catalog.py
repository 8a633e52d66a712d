"""The registered queries: one for each operator of the engine, over panels of the test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrant.functions.scores import Score
from calibrant.functions.stats import FIELDS
from calibrant.operators import calibrate as cp
from calibrant.operators import copula as cl
from calibrant.operators import joint as jp
from calibrant.operators import metrics as mt
from calibrant.operators import ranks as rk
from calibrant.operators import scales as sc
from calibrant.operators import segments as sg
from calibrant.plans import oracle as sql
from calibrant.sources import panels as ps
from calibrant.sources.shared import shared_path, stored

Query = Callable[[SparkSession, str], DataFrame]

ALPHA = 0.2
KEYS = ["series", "h"]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order give the same value."""
    return df.select(*[F.round(c.name, digits).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name) for c in df.schema])


def register(name: str, oracle: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def flat(panel: DataFrame) -> DataFrame:
    return panel.select("series", "w", "h", "y", "yhat", *[F.col(f"q.{f}").alias(f) for f in FIELDS], "split")


def _panels() -> None:
    for kind, build in ps.PANELS.items():
        register(f"panel_{'nation_weekly' if kind == 'weekly' else kind}", f"WITH {sql.panel(kind)} SELECT series, w, h, {sql.rounded('y, yhat, ' + sql.Q)}, split FROM panel")(lambda s, d, b=build: flat(b(s, d)))


def _scores() -> None:
    for name in sql.SCORE:
        register(f"score_{name}", f"WITH {sql.scored('user', name)} SELECT series, w, h, split, round(s, 6) AS s FROM scored")(
            lambda s, d, n=name: sc.scored(ps.user_panel(s, d), n, ALPHA, KEYS[:1]).select("series", "w", "h", "split", "s")
        )
    for name in sql.BOUNDS:
        register(f"invert_{name}", f"WITH {sql.scored('user', name)}, {sql.split_thr()}, {sql.bounded(name)} SELECT series, w, h, {sql.rounded('thr, lo, hi')} FROM iv")(lambda s, d, n=name: interval(cp.split_cp(sc.scored(ps.user_panel(s, d), n, ALPHA, KEYS[:1]), KEYS, ALPHA), n).select("series", "w", "h", "thr", "lo", "hi"))


def interval(rows: DataFrame, score: str, alpha: float = ALPHA) -> DataFrame:
    """lo and hi from thr, or from q_lo and q_up."""
    two = "q_lo" in rows.columns
    lo, hi = Score(score, alpha).bounds(*(("q_lo", "q_up") if two else ("thr", "thr")), asymmetric=two)
    return rows.withColumn("lo", lo).withColumn("hi", hi)


def user_scores(spark: SparkSession, sf_dir: str, score: str = "abs") -> DataFrame:
    return sc.scored(ps.user_panel(spark, sf_dir), score, ALPHA, KEYS[:1])


_panels()
_scores()


@register("score_asym_pair", f"WITH {sql.panel('user')}, {sql.BASE} SELECT series, w, h, split, round({sql.SIGNED['scaled_cqr'][0]}, 6) AS s_lo, round({sql.SIGNED['scaled_cqr'][1]}, 6) AS s_up FROM base")
def score_asym_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.scored(ps.user_panel(spark, sf_dir), "scaled_cqr", ALPHA, KEYS[:1], asymmetric=True).select("series", "w", "h", "split", "s_lo", "s_up")


@register("scales_mad", f"WITH {sql.panel('user')}, {sql.SCALES} SELECT h, {sql.rounded('iqr_floor, rho_mad, sigma_lo, sigma_hi')} FROM scales")
def scales_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.robust_scales(ps.user_panel(spark, sf_dir), ALPHA)


@register("log_preflight", f"WITH {sql.panel('weekly')} SELECT coalesce(bool_or((split = 'cal' AND y + 1e-6 <= 0) OR yhat + 1e-6 <= 0), false) AS fallback FROM panel")
def log_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.log_falls_back(ps.weekly_panel(spark, sf_dir))


@register("prev_residual", f"WITH {sql.panel('user')}, {sql.BASE} SELECT series, w, h, round(prev, 6) AS prev FROM base")
def prev_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.with_prev(ps.user_panel(spark, sf_dir), ["series"]).select("series", "w", "h", "prev")


def _thr_sql(xs: str, alpha: float, score: str = "abs", correction: bool = True) -> str:
    return f"WITH {sql.scored('user', score)}, fr AS ({xs}) SELECT series, w, h, round({sql.quantile('xs', alpha, correction)}, 6) AS thr FROM fr WHERE split = 'test'"


def _frame(size: int | None) -> str:
    rows = "UNBOUNDED PRECEDING" if size is None else f"{size} PRECEDING"
    return f"SELECT *, list_sort(list(s) OVER (PARTITION BY series, h ORDER BY w ROWS BETWEEN {rows} AND 1 PRECEDING)) AS xs FROM scored"


THR = ("series", "w", "h", "thr")


@register("splitcp", f"WITH {sql.scored('user', 'abs')}, {sql.split_thr()} SELECT series, w, h, round(thr, 6) AS thr FROM thr")
def splitcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.split_cp(user_scores(spark, sf_dir), KEYS, ALPHA).select(*THR)


@register("cfrnn", f"WITH {sql.scored('user', 'abs')}, {sql.split_thr(ALPHA / 4)} SELECT series, w, h, round(thr, 6) AS thr FROM thr")
def cfrnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.cfrnn(user_scores(spark, sf_dir), KEYS, ALPHA, 4).select(*THR)


@register("trailing_window", _thr_sql(_frame(20), ALPHA, correction=False))
def trailing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.trailing(user_scores(spark, sf_dir), KEYS, ALPHA, 20).select(*THR)


@register("cqr_rolling", _thr_sql(_frame(None), ALPHA, "cqr"))
def cqr_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantile of all scores before each step."""
    return rk.past_quantiles(user_scores(spark, sf_dir, "cqr"), KEYS, ALPHA).select(*THR)


def _weighted_sql(size: int, decay: float) -> str:
    return f"""WITH {sql.scored("user", "abs")},
    pairs AS (SELECT a.series, a.w, a.h, b.s, pow({decay}::DOUBLE, a.w - 1 - b.w) AS p FROM scored a JOIN scored b ON a.series = b.series AND a.h = b.h AND b.w < a.w AND b.w >= a.w - {size} WHERE a.split = 'test'),
    cum AS (SELECT *, sum(p) OVER (PARTITION BY series, w, h ORDER BY s, p) AS c, sum(p) OVER (PARTITION BY series, w, h) + 1.0 AS total FROM pairs)
    SELECT series, w, h, round(coalesce(min(s) FILTER (WHERE c >= 0.8::DOUBLE * total), 'inf'::DOUBLE), 6) AS thr FROM cum GROUP BY series, w, h"""


@register("weighted_cp", _weighted_sql(20, 0.95))
def weighted_cp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.weighted(user_scores(spark, sf_dir), KEYS, ALPHA, 20, decay=0.95).select(*THR)


def _aci_sql(scored: str, alpha: float, gamma: float, size: int, keys: str = "series, h", order: str = "w", pick: str = "series, w, h, round(thr, 6) AS thr, round(a, 6) AS alpha_t", first: int | str = 5) -> str:
    k = [x.strip() for x in keys.split(",")]
    on = " AND ".join(f"r.{x} = n.{x}" for x in k)
    return f"""WITH RECURSIVE {scored},
    b AS (SELECT *, list_sort(list(s) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING)) AS xs FROM scored),
    r AS (SELECT b.*, {alpha}::DOUBLE AS a, {sql.quantile("xs", alpha)} AS thr FROM b WHERE {order} = {first}
        UNION ALL
        SELECT *, {sql.quantile("xs", "a")} AS thr FROM (SELECT n.*, least(greatest(r.a + {gamma}::DOUBLE * ({alpha}::DOUBLE - CASE WHEN r.s > r.thr THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0.0), 1.0) AS a FROM r JOIN b n ON {on} AND n.{order} = r.{order} + 1))
    SELECT {pick} FROM r"""


@register("aci", _aci_sql(sql.scored("user", "abs"), ALPHA, 0.05, 20))
def aci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.aci(user_scores(spark, sf_dir), KEYS, ALPHA, 0.05, 20).select(*THR, "alpha_t")


@register("adaptive_cqr_aci", _aci_sql(sql.scored("user", "cqr"), ALPHA, 0.05, 20))
def adaptive_cqr_aci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.aci(user_scores(spark, sf_dir, "cqr"), KEYS, ALPHA, 0.05, 20).select(*THR, "alpha_t")


def _tails_sql(score: str) -> str:
    lo, up = sql.SIGNED[score]
    return f"{sql.panel('user')}, {sql.BASE}, scored AS (SELECT *, 'lo' AS tail, {lo} AS s FROM base UNION ALL SELECT *, 'up', {up} FROM base)"


PAIR = "series, w, h, round(max(thr) FILTER (WHERE tail = 'lo'), 6) AS q_lo, round(max(thr) FILTER (WHERE tail = 'up'), 6) AS q_up"


@register("splitcp_asym", f"WITH {_tails_sql('signed')}, {sql.split_thr(ALPHA / 2, 'series, h, tail')} SELECT {PAIR} FROM thr GROUP BY series, w, h")
def splitcp_asym(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sc.scored(ps.user_panel(spark, sf_dir), "signed", ALPHA, KEYS[:1], asymmetric=True)
    return cp.both_tails(cp.split_cp, rows, KEYS, ALPHA)


@register("aci_asym", _aci_sql(_tails_sql("cqr"), ALPHA / 2, 0.05, 20, "series, h, tail", pick=PAIR) + " GROUP BY series, w, h")
def aci_asym(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sc.scored(ps.user_panel(spark, sf_dir), "cqr", ALPHA, KEYS[:1], asymmetric=True)
    return cp.both_tails(cp.aci, rows, KEYS, ALPHA, gamma=0.05, size=20)


def _pid_sql(ki: float, score: str = "abs") -> str:
    angle = "(e - n * 0.2::DOUBLE) * ln(n + 1) / (n + 1)"
    part = f"CASE WHEN abs({angle}) < 1.5707963267948966 THEN {ki}::DOUBLE * tan({angle}) ELSE 0.0 END" if ki else "0.0"
    return f"""WITH RECURSIVE {sql.scored("user", score)}, {sql.split_thr()},
    b AS (SELECT *, max(s) OVER (PARTITION BY series, h ORDER BY w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) - min(s) OVER (PARTITION BY series, h ORDER BY w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS spread FROM scored),
    x AS (SELECT b.*, thr.thr AS q0 FROM b JOIN thr ON b.series = thr.series AND b.h = thr.h AND b.w = thr.w),
    r AS (SELECT *, q0 AS qt, q0 AS thr, 0.0::DOUBLE AS e, 0.0::DOUBLE AS n FROM x WHERE w = 5
        UNION ALL
        SELECT nx.*, r.qt - 0.1::DOUBLE * r.spread * (0.2::DOUBLE - CASE WHEN r.s > r.thr THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),
               r.qt - 0.1::DOUBLE * r.spread * (0.2::DOUBLE - CASE WHEN r.s > r.thr THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + {part},
               e + CASE WHEN r.s > r.thr THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, n + 1
        FROM r JOIN x nx ON r.series = nx.series AND r.h = nx.h AND nx.w = r.w + 1)
    SELECT series, w, h, round(thr, 9) AS thr FROM r"""


@register("pid", _pid_sql(0.0), digits=9)
def pid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.pid(user_scores(spark, sf_dir), KEYS, ALPHA, 0.1, size=20).select(*THR)


@register("pid_integral", _pid_sql(0.5), digits=9)
def pid_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.pid(user_scores(spark, sf_dir), KEYS, ALPHA, 0.1, ki=0.5, size=20).select(*THR)


@register("adaptive_cqr_pid", _pid_sql(0.0, "cqr"), digits=9)
def adaptive_cqr_pid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.pid(user_scores(spark, sf_dir, "cqr"), KEYS, ALPHA, 0.1, size=20).select(*THR)


_FLAT = f"{sql.scored('user', 'abs')[: -len('SELECT *, ' + sql.SCORE['abs'] + ' AS s FROM base)')]}SELECT *, w * 4 + h AS pos, {sql.SCORE['abs']} AS s FROM base)"


@register("single_step_online", _aci_sql(_FLAT, ALPHA, 0.05, 20, "series", "pos", "series, w, h, round(thr, 6) AS thr", 20))
def single_step_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.single_step(user_scores(spark, sf_dir), ["series"], ALPHA, 4, True, 0.05, 20).select(*THR)


_MOVE = "least(greatest({a} + 0.05::DOUBLE * (0.2::DOUBLE - CASE WHEN {s} > thr THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0.0), 1.0)"


def _moved(steps: int) -> str:
    a = "a"
    for k in range(1, steps + 1):
        a = _MOVE.format(a=a, s=f"ss[{k}]")
    return a


@register(
    "single_step_offline",
    f"""WITH RECURSIVE {_FLAT},
    b AS (SELECT *, list_sort(list(s) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) AS xs FROM scored),
    g AS (SELECT series, w, first(xs ORDER BY h) AS xs, list(s ORDER BY h) AS ss FROM b GROUP BY series, w),
    r AS (SELECT *, 0.2::DOUBLE AS a, {sql.quantile("xs", ALPHA)} AS thr FROM g WHERE w = 5
        UNION ALL
        SELECT *, {sql.quantile("xs", "a")} AS thr FROM (SELECT n.*, {_moved(4).replace("ss[", "r.ss[").replace("(a +", "(r.a +").replace("> thr", "> r.thr")} AS a FROM r JOIN g n ON r.series = n.series AND n.w = r.w + 1))
    SELECT r.series, r.w, b.h, round(thr, 6) AS thr FROM r JOIN b ON r.series = b.series AND r.w = b.w""",
)
def single_step_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.single_step(user_scores(spark, sf_dir), ["series"], ALPHA, 4, False, 0.05, 20).select(*THR)


# Metrics and summaries -------------------------------------------------------------------------------------------

from calibrant.operators import folds as fd  # noqa: E402
from calibrant.operators import reports as rp  # noqa: E402
from calibrant.plans import cache as ch  # noqa: E402
from calibrant.plans import evaluate as ev  # noqa: E402

_IV = f"{sql.scored('user', 'abs')}, {sql.split_thr()}, {sql.bounded('abs')}, {sql.marked()}"
_NATIVE = f"{sql.panel('user')}, nt AS (SELECT *, q10 AS lo, q90 AS hi FROM panel WHERE split = 'test'), {sql.marked('nt', name='mk')}"
_JOINT_COVERAGE = "jc AS (SELECT avg(CAST(a AS INT)::DOUBLE) AS joint_coverage FROM (SELECT series, w, bool_and(coalesce(covered = 1, false)) AS a FROM mk GROUP BY series, w))"


def split_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.marks(interval(cp.split_cp(user_scores(spark, sf_dir), KEYS, ALPHA), "abs"), ALPHA)


@register("native_metrics", f"WITH {_NATIVE}, {sql.horizon_metrics()} SELECT h, {sql.rounded('coverage, avg_width, winkler_score')} FROM mh")
def native_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.by_horizon(mt.marks(mt.native(ps.user_panel(spark, sf_dir), ALPHA), ALPHA)).drop("frac_infinite")


@register("native_metrics_missing", f"WITH {sql.panel('hourly')}, nt AS (SELECT *, q10 AS lo, q90 AS hi FROM panel WHERE split = 'test'), {sql.marked('nt', name='mk')}, {sql.horizon_metrics()} SELECT h, {sql.rounded('coverage, avg_width, winkler_score')} FROM mh")
def native_metrics_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.by_horizon(mt.marks(mt.native(ps.hourly_panel(spark, sf_dir), ALPHA), ALPHA)).drop("frac_infinite")


@register("metrics_by_horizon", f"WITH {_IV}, {sql.horizon_metrics()} SELECT h, {sql.rounded('coverage, avg_width, winkler_score')} FROM mh")
def metrics_by_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.by_horizon(split_intervals(spark, sf_dir)).drop("frac_infinite")


@register("joint_coverage", f"WITH {_IV}, {_JOINT_COVERAGE} SELECT round(joint_coverage, 6) AS joint_coverage FROM jc")
def joint_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.joint_coverage(split_intervals(spark, sf_dir))


@register("winkler", f"WITH {_IV} SELECT series, w, h, {sql.rounded('covered, width, winkler')} FROM mk")
def winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_intervals(spark, sf_dir).select("series", "w", "h", "covered", "width", "winkler")


@register("rolling_metrics", f"WITH {_IV} SELECT series, w, h, round(avg(covered) OVER f, 6) AS rolling_coverage, round(avg(width) OVER f, 6) AS rolling_width FROM mk WINDOW f AS (PARTITION BY series, h ORDER BY w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def rolling_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.rolling(split_intervals(spark, sf_dir), KEYS, size=5).select("series", "w", "h", "rolling_coverage", "rolling_width")


@register("burnin", f"WITH {_IV}, bi AS (SELECT * FROM mk QUALIFY row_number() OVER (PARTITION BY series, h ORDER BY w) > 2), {sql.horizon_metrics('bi')} SELECT h, {sql.rounded('coverage, avg_width, winkler_score')} FROM mh")
def burnin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.by_horizon(mt.burn_in(split_intervals(spark, sf_dir), KEYS, 2)).drop("frac_infinite")


_COMPARE = f"""{sql.scored("user", "abs")}, {sql.split_thr()},
    fr AS (SELECT *, list_sort(list(s) OVER (PARTITION BY series, h ORDER BY w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) AS xs FROM scored),
    iv AS (SELECT 'Native' AS method, series, w, h, y, q10 AS lo, q90 AS hi FROM base WHERE split = 'test'
        UNION ALL SELECT 'SplitCP', series, w, h, y, yhat - thr, yhat + thr FROM thr
        UNION ALL SELECT 'TrailingWindow', series, w, h, y, yhat - {sql.quantile("xs", ALPHA, False)}, yhat + {sql.quantile("xs", ALPHA, False)} FROM fr WHERE split = 'test'),
    {sql.marked()}, {sql.horizon_metrics(by="method")},
    jc AS (SELECT method, avg(CAST(a AS INT)::DOUBLE) AS joint_coverage FROM (SELECT method, series, w, bool_and(coalesce(covered = 1, false)) AS a FROM mk GROUP BY ALL) GROUP BY method),
    su AS (SELECT method, avg(coverage) AS coverage, avg(avg_width) AS avg_width, avg(winkler_score) AS winkler_score FROM mh GROUP BY method),
    nv AS (SELECT avg_width AS nw, winkler_score AS nk FROM su WHERE method = 'Native')
    SELECT method, {sql.rounded("coverage, avg_width, winkler_score, joint_coverage")}, round(avg_width / CASE WHEN nw > 1e-8 THEN nw ELSE 1 END, 6) AS scaled_width, round(winkler_score / CASE WHEN nk > 1e-8 THEN nk ELSE 1 END, 6) AS scaled_winkler
    FROM su JOIN jc USING (method), nv"""


@register("compare_methods", f"WITH {_COMPARE}")
def compare_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.run(ps.user_panel(spark, sf_dir), ev.EvalConfig(methods=("SplitCP", "TrailingWindow"), window=20))


_WEEKLY = f"""{sql.scored("weekly", "abs")}, {sql.split_thr()},
    iv AS (SELECT 'Native' AS method, series, w, h, y, q10 AS lo, q90 AS hi FROM base WHERE split = 'test' UNION ALL SELECT 'SplitCP', series, w, h, y, yhat - thr, yhat + thr FROM thr),
    {sql.marked()}, {sql.horizon_metrics(by="method")},
    jc AS (SELECT method, avg(CAST(a AS INT)::DOUBLE) AS joint_coverage FROM (SELECT method, series, w, bool_and(coalesce(covered = 1, false)) AS a FROM mk GROUP BY ALL) GROUP BY method),
    su AS (SELECT method, avg(coverage) AS coverage, avg(avg_width) AS avg_width, avg(winkler_score) AS winkler_score FROM mh GROUP BY method),
    nv AS (SELECT avg_width AS nw, winkler_score AS nk FROM su WHERE method = 'Native')
    SELECT method, {sql.rounded("coverage, avg_width, winkler_score, joint_coverage", 3)}, round(avg_width / nw, 3) AS scaled_width, round(winkler_score / nk, 3) AS scaled_winkler FROM su JOIN jc USING (method), nv"""


@register("summary_scaled", f"WITH {_WEEKLY}", digits=3)
def summary_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: weekly revenue of nations, split conformal intervals against the forecast's own."""
    return ev.run(ps.weekly_panel(spark, sf_dir), ev.EvalConfig(methods=("SplitCP",)))


# Cross-sectional and joint methods -------------------------------------------------------------------------------


def _fold_sql(folds: int, seed: int = 42) -> str:
    return f"CAST(CAST('0x' || substr(md5(series || ':{seed}'), 1, 15) AS BIGINT) % {folds} AS INT)"


def _kfold_sql(folds: int, seed: int) -> str:
    return f"""WITH {sql.scored("user", "abs")}, p AS (SELECT *, {_fold_sql(folds, seed)} AS fold FROM scored),
    t AS (SELECT g.fold, h, list_sort(list(s)) AS xs FROM p JOIN (SELECT unnest(range(0, {folds})) AS fold) g ON g.fold <> p.fold GROUP BY g.fold, h)
    SELECT series, w, p.h, p.fold, round({sql.quantile("xs", ALPHA)}, 6) AS thr FROM p LEFT JOIN t ON p.fold = t.fold AND p.h = t.h"""


@register("kfold_splitcp", _kfold_sql(5, 42))
def kfold_splitcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.split_cp_folds(user_scores(spark, sf_dir), ALPHA, 5).select("series", "w", "h", "fold", "thr")


@register("kfold_shuffled", _kfold_sql(5, 7))
def kfold_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another seed's folds, as many as the rule gives."""
    rows = user_scores(spark, sf_dir)
    n = fd.fold_count(ps.USER["cal"], 12, rows.select(F.countDistinct("series")).first()[0])
    return fd.split_cp_folds(rows, ALPHA, n, seed=7).select("series", "w", "h", "fold", "thr")


@register("covariate_strategy", f"WITH {sql.panel('hourly')} SELECT series, count(*) AS n FROM panel WHERE series = (SELECT min(series) FROM panel) GROUP BY series")
def covariate_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.chosen_series(ps.hourly_panel(spark, sf_dir), "targets_only").groupBy("series").agg(F.count("*").alias("n"))


_R = f"{sql.panel('user')}, r AS (SELECT *, abs(y - yhat) AS r FROM panel), cal AS (SELECT * FROM r WHERE split = 'cal')"


@register("joint_cfrnn", f"WITH {_R}, x AS (SELECT h, list_sort(list(r)) AS xs FROM cal GROUP BY h) SELECT h, round({sql.quantile('xs', ALPHA / 4)}, 6) AS radius FROM x")
def joint_cfrnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jp.joint_cfrnn(ps.user_panel(spark, sf_dir), ALPHA, 4)


@register("normmax", f"""WITH {_R}, sg AS (SELECT h, CASE WHEN avg(r) >= 1e-8 THEN avg(r) ELSE 1 END AS sigma FROM cal GROUP BY h),
    m AS (SELECT list_sort(list(m)) AS xs FROM (SELECT max(r / sigma) AS m FROM cal JOIN sg USING (h) GROUP BY series, w)) SELECT h, round(sigma * {sql.quantile("xs", ALPHA)}, 6) AS radius FROM sg, m""")
def normmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jp.norm_max(ps.user_panel(spark, sf_dir), ALPHA)


@register("copula_bisect", f"""WITH {_R}, po AS (SELECT series, w, row_number() OVER (ORDER BY w, series) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT series, w FROM cal)),
    lo AS (SELECT cal.*, pos, n FROM cal JOIN po USING (series, w)), e AS (SELECT h, list_sort(list(r)) AS es FROM lo WHERE pos < floor(0.6 * n) GROUP BY h),
    u AS (SELECT pos, max(len(list_filter(es, lambda x: x <= r)) / len(es)) AS u FROM lo JOIN e USING (h) WHERE pos >= floor(0.6 * n) GROUP BY pos, n),
    th AS (SELECT list_sort(list(u))[CAST(ceil(count(*) * 0.8::DOUBLE) AS INT)] AS theta FROM u),
    k AS (SELECT h, es, theta * (len(es) - 1) AS pos FROM e, th)
    SELECT h, round(es[1 + CAST(floor(pos) AS INT)] + (es[least(2 + CAST(floor(pos) AS INT), len(es))] - es[1 + CAST(floor(pos) AS INT)]) * (pos - floor(pos)), 6) AS radius FROM k""")
def copula_bisect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jp.copula_bisection(ps.user_panel(spark, sf_dir), ALPHA)


@register("joint_metrics", f"""WITH {_R}, x AS (SELECT h, list_sort(list(r)) AS xs FROM cal GROUP BY h), rad AS (SELECT h, {sql.quantile('xs', ALPHA / 4)} AS radius FROM x),
    iv AS (SELECT p.*, yhat - radius AS lo, yhat + radius AS hi FROM panel p JOIN rad USING (h) WHERE split = 'test'), {sql.marked()}, {_JOINT_COVERAGE}, {sql.horizon_metrics()}
    SELECT round(avg(coverage), 6) AS coverage, round(avg(avg_width), 6) AS avg_width, round(avg(winkler_score), 6) AS winkler_score, round(any_value(joint_coverage), 6) AS joint_coverage FROM mh, jc""")
def joint_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = ps.user_panel(spark, sf_dir)
    marked = mt.marks(jp.with_radii(panel, jp.joint_cfrnn(panel, ALPHA, 4)), ALPHA).withColumn("method", F.lit("JointCFRNN"))
    return mt.summary(marked, ["method"]).drop("method")


def _cafht_sql(step: str, start: str) -> str:
    """Paths of thresholds by step: `start` is the first state, `step` the next one and the threshold q."""
    violation = "list_max(list_transform(range(1, len(r) + 1), lambda j: greatest(r[j] - qs[j], 0.0) / greatest(qs[j], 1e-8)))"
    return f"""WITH RECURSIVE {_R}, tr AS (SELECT series, w, split, list(r ORDER BY h) AS r FROM r GROUP BY series, w, split),
    g AS (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in jp.GAMMAS)}]) AS gamma),
    p AS (SELECT series, w, split, r, gamma, 0 AS i, {start}, CAST([] AS DOUBLE[]) AS qs FROM tr, g
        UNION ALL SELECT series, w, split, r, gamma, i + 1, {step}),
    v AS (SELECT *, {violation} AS v FROM p WHERE i = len(r)),
    tried AS (SELECT gamma, list_sort(list(v)) AS vs, avg(list_sum(qs) / len(qs)) AS mean_q FROM v WHERE split = 'cal' AND w < 2 GROUP BY gamma),
    best AS (SELECT arg_min(gamma, {{'b': round((1 + {sql.quantile("vs", ALPHA)}) * 2 * mean_q, 9), 'g': gamma}}) AS gamma FROM tried),
    ep AS (SELECT list_sort(list(v)) AS vs FROM v JOIN best USING (gamma) WHERE split = 'cal' AND w >= 2),
    fin AS (SELECT series, w, gamma, {sql.quantile("vs", ALPHA)} AS eps, qs, unnest(range(0, len(qs))) AS h FROM v JOIN best USING (gamma), ep WHERE split = 'test')
    SELECT series, w, CAST(h AS INT) AS h, gamma, round(eps, 6) AS eps, round((1 + eps) * qs[h + 1], 6) AS radius FROM fin"""


_ACI_STEP = """least(greatest(a + gamma * (0.2::DOUBLE - CASE WHEN r[i + 1] > q THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0.0), 1.0), list_append(qs, q)
        FROM (SELECT *, CASE WHEN i < ceil(1 / greatest(a, 1e-9)) THEN 0.1::DOUBLE ELSE list_sort(r[1:i])[greatest(1, least(i, CAST(ceil(i * (1 - a)) AS INT)))] END AS q FROM p WHERE i < len(r))"""
_PID_STEP = """qt - rate * CASE WHEN r[i + 1] <= q THEN 0.2::DOUBLE ELSE 0.2::DOUBLE - 1.0 END, list_append(qs, q)
        FROM (SELECT *, greatest(qt, 0.0) AS q, CASE WHEN i > 1 THEN gamma * (list_max(r[1:i]) - list_min(r[1:i])) ELSE gamma END AS rate FROM p WHERE i < len(r))"""


def _cafht(spark: SparkSession, sf_dir: str, path) -> DataFrame:
    got = jp.cafht(ps.user_panel(spark, sf_dir), ALPHA, ps.USER["cal"], path)
    return got.select("series", "w", "gamma", "eps", F.posexplode("radii").alias("h", "radius"))


@register("cafht_aci", _cafht_sql(_ACI_STEP, "0.2::DOUBLE AS a"))
def cafht_aci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cafht(spark, sf_dir, jp.aci_path)


@register("cafht_pid", _cafht_sql(_PID_STEP, "0.1::DOUBLE AS qt"))
def cafht_pid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cafht(spark, sf_dir, jp.pid_path)


# Reports ---------------------------------------------------------------------------------------------------------

_RES = f"""{sql.panel("user")}, nseries AS (SELECT 't' || CAST(CAST(series AS INT) % 4 AS VARCHAR) AS task, count(DISTINCT series) AS n_series FROM panel GROUP BY 1),
    mo AS (SELECT 'mean' AS model, series, w, h, y, yhat AS p, q10, q90, split FROM panel UNION ALL SELECT 'median', series, w, h, y, q50, q10, q90, split FROM panel),
    ms AS (SELECT *, abs(y - p) AS s, 't' || CAST(CAST(series AS INT) % 4 AS VARCHAR) AS task FROM mo),
    mf AS (SELECT *, list_sort(list(s) FILTER (WHERE split = 'cal') OVER (PARTITION BY model, series, h)) AS cal, list_sort(list(s) OVER (PARTITION BY model, series, h ORDER BY w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) AS past FROM ms),
    mt AS (SELECT *, {sql.quantile("cal", ALPHA)} AS a, {sql.quantile("cal", ALPHA / 4)} AS b, {sql.quantile("past", ALPHA, False)} AS c FROM mf WHERE split = 'test'),
    iv AS (SELECT task, model, 'Native' AS method, series, w, h, y, q10 AS lo, q90 AS hi FROM mt UNION ALL SELECT task, model, 'SplitCP', series, w, h, y, p - a, p + a FROM mt
        UNION ALL SELECT task, model, 'CFRNN', series, w, h, y, p - b, p + b FROM mt UNION ALL SELECT task, model, 'TrailingWindow', series, w, h, y, p - c, p + c FROM mt),
    {sql.marked()}, {sql.horizon_metrics(by="task, model, method")},
    jc AS (SELECT task, model, method, avg(CAST(a AS INT)::DOUBLE) AS joint_coverage FROM (SELECT task, model, method, series, w, bool_and(coalesce(covered = 1, false)) AS a FROM mk GROUP BY ALL) GROUP BY ALL),
    res AS (SELECT task, model, method, avg(coverage) AS coverage, any_value(joint_coverage) AS joint_coverage, avg(avg_width) AS avg_width, avg(winkler_score) AS winkler_score, any_value(n_series) AS n_series
        FROM mh JOIN jc USING (task, model, method) JOIN nseries USING (task) GROUP BY task, model, method)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.results(ps.user_panel(spark, sf_dir), ALPHA, ps.USER["horizon"], F.concat(F.lit("t"), F.pmod(F.col("series").cast("int"), F.lit(4)).cast("string")))


def report(name: str, query: str, digits: int = 6) -> Callable[[Callable[[DataFrame], DataFrame]], None]:
    def add(f: Callable[[DataFrame], DataFrame]) -> None:
        register(name, f"WITH {_RES} {query}", digits)(lambda spark, sf_dir: f(results(spark, sf_dir)))

    return add


_M = "coverage, joint_coverage, avg_width, winkler_score"
report("results", f"SELECT task, model, method, {sql.rounded(_M)}, n_series FROM res")(lambda r: r)
report("rollup_mean_median", "SELECT model, method, " + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(median({m}), 6) AS {m}_median" for m in _M.split(", ")) + ", CAST(sum(n_series) AS BIGINT) AS n_series FROM res GROUP BY model, method")(lambda r: rp.mean_median(r, ["model", "method"]))
report("series_weighted", "SELECT model, method, " + ", ".join(f"round(sum({m} * n_series) / sum(n_series), 6) AS {m}" for m in _M.split(", ")) + " FROM res GROUP BY model, method")(lambda r: rp.series_weighted(r, ["model", "method"], rp.METRICS))
report("weighted_median", "SELECT model, method, round(min(avg_width) FILTER (WHERE run >= total / 2), 6) AS avg_width FROM (SELECT *, sum(n_series) OVER (PARTITION BY model, method ORDER BY avg_width) AS run, sum(n_series) OVER (PARTITION BY model, method) AS total FROM res) GROUP BY model, method")(lambda r: rp.weighted_median(r, ["model", "method"], "avg_width", "n_series"))
report("best_method", "SELECT task, model, arg_min(method, {'m': winkler_score, 'n': method}) AS method, round(min(winkler_score), 6) AS winkler_score FROM res GROUP BY task, model")(lambda r: rp.best(r, ["task", "model"]))
report("closest_coverage", "SELECT task, model, arg_min(method, {'m': round(abs(coverage - 0.8::DOUBLE), 9), 'n': method}) AS method, round(min(abs(coverage - 0.8::DOUBLE)), 6) AS gap FROM res GROUP BY task, model")(lambda r: rp.closest(r, ["task", "model"], 0.8))
report("top5", "SELECT model, task, method, round(winkler_score, 6) AS winkler_score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(winkler_score, 9), method || task) AS rank FROM res) WHERE rank <= 5")(lambda r: rp.top(r.withColumn("k", F.concat("method", "task")).withColumn("o", F.round("winkler_score", 9)), ["model"], "o", 5, tie="k").select("model", "task", "method", "winkler_score", "rank"))
report("relational_division", "SELECT task, count(*) AS n FROM res WHERE task IN (SELECT task FROM res GROUP BY task HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM res)) GROUP BY task")(lambda r: rp.with_all(r, "task", "model").groupBy("task").agg(F.count("*").alias("n")))
report("cross_model_width", "SELECT task, model, method, round(avg_width / nullif(avg(avg_width) FILTER (WHERE method = 'Native') OVER (PARTITION BY task), 0), 6) AS width_ratio FROM res")(lambda r: rp.normalised_width(r).select("task", "model", "method", "width_ratio"))
report("coverage_deviation", "SELECT model, method, round(sum(abs(coverage - 0.8::DOUBLE) * n_series) / sum(n_series), 6) AS deviation FROM res GROUP BY model, method")(lambda r: rp.coverage_deviation(r, ["model", "method"], 0.8))
report("horizon_category", "SELECT CASE WHEN n_series <= 30 THEN 'short' WHEN n_series <= 90 THEN 'medium' ELSE 'long' END AS category, count(*) AS n FROM res GROUP BY 1")(lambda r: r.groupBy(rp.horizon_category("n_series").alias("category")).agg(F.count("*").alias("n")))
report("union_padded", "SELECT task, method, round(coverage, 6) AS coverage, NULL::DOUBLE AS avg_width FROM res WHERE model = 'mean' UNION ALL SELECT task, method, NULL, round(avg_width, 6) FROM res WHERE model = 'median'")(lambda r: rp.union_padded([r.where("model = 'mean'").select("task", "method", "coverage"), r.where("model = 'median'").select("task", "method", "avg_width")]))
report("totals_cube", f"SELECT model, method, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _M.split(', '))} FROM res GROUP BY CUBE (model, method)")(lambda r: rp.totals(r))
report("filter_rows", "SELECT task, model, method, round(coverage, 6) AS coverage FROM res WHERE task IN ('t0', 't1') AND coverage >= 0.5")(lambda r: rp.filtered(r, task=("t0", "t1"), coverage__ge=0.5).select("task", "model", "method", "coverage"))
report("page", "SELECT task, model, method FROM res ORDER BY task || model || method NULLS LAST LIMIT 7 OFFSET 7")(lambda r: rp.page(r.withColumn("k", F.concat("task", "model", "method")), "k", 2, 7, "method").select("task", "model", "method"))
report("distinct_values", "SELECT count(DISTINCT task) AS tasks, count(DISTINCT model) AS models, count(DISTINCT method) AS methods FROM res")(lambda r: r.agg(*[F.countDistinct(c).alias(f"{c}s") for c in ("task", "model", "method")]))
report("metadata_join", "SELECT task, model, method, n_series, n_series * 2 AS n_series_meta FROM res")(lambda r: rp.with_metadata(r.select("task", "model", "method", "n_series"), r.select("task", (F.col("n_series") * 2).alias("n_series")).distinct()))
report("prefer_summary", "SELECT task, model, method, round(coalesce(CASE WHEN coverage > 0.8 THEN coverage END, m), 6) AS coverage FROM res JOIN (SELECT method, avg(coverage) AS m FROM res GROUP BY method) USING (method)")(lambda r: rp.prefer_summary(r.withColumn("coverage", F.when(F.col("coverage") > 0.8, F.col("coverage"))), r.groupBy("method").agg(F.avg("coverage").alias("coverage")), ["method"], ("coverage",)).select("task", "model", "method", "coverage"))


@register("param_grid", "SELECT a.alpha, s.score, c.cal FROM (VALUES (0.1::DOUBLE), (0.2::DOUBLE)) a(alpha), (VALUES ('abs'), ('cqr')) s(score), (VALUES (5::BIGINT), (10::BIGINT)) c(cal)")
def param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.grid(spark, alpha=[0.1, 0.2], score=["abs", "cqr"], cal=[5, 10])


# NumPy kernels ---------------------------------------------------------------------------------------------------

from calibrant.operators import kernels as kn  # noqa: E402


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.user_panel(spark, sf_dir).withColumn("e", F.col("y") - F.col("yhat"))


def _agaci_sql(score: str, method: str = "") -> str:
    """The experts' states as lists; a row's threshold comes from the state before it."""
    g = "[0.001::DOUBLE, 0.005::DOUBLE, 0.01::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE]"
    each = lambda f: f"list_transform(range(1, 6), lambda j: {f})"
    fives = lambda x: f"[{', '.join([x] * 5)}]"
    guarded = "CASE WHEN len(xs) < ceil(1 / greatest(lv[j], 1e-9)) THEN 'inf'::DOUBLE ELSE xs[1 + CAST(least(ceil(least(greatest(1 - lv[j], 0.0), 1.0) * (len(xs) - 1)), len(xs) - 1) AS INT)] END"
    return f"""{sql.scored("user", score)},
    b AS (SELECT *, list_sort(list(s) OVER (PARTITION BY series, h ORDER BY w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) AS xs FROM scored),
    r AS (SELECT series, h, w, s, xs, {fives("0.2::DOUBLE")} AS lv, {fives("0.2::DOUBLE")} AS sh, {fives("0.0::DOUBLE")} AS rt, {fives("0.0::DOUBLE")} AS sq, {fives("0.0::DOUBLE")} AS mx, {fives("0.0::DOUBLE")} AS ls, 0.2::DOUBLE AS level, {sql.quantile("xs", ALPHA)} AS thr FROM b WHERE w = 5
        UNION ALL
        SELECT series, h, w, s, xs, lv, sh, rt, sq, mx, ls, level, {sql.quantile("xs", "level")} FROM (
        SELECT n.series, n.h, n.w, n.s, n.xs, lv2 AS lv, sh, rt, sq, mx, ls, least(greatest(list_sum({each("sh[j] * lv2[j]")}), 0.0), 1.0) AS level FROM (
        SELECT *, {each("wt[j] / list_sum(wt)")} AS sh FROM (
        SELECT *, {each("rt[j] * exp(list_min(" + each("rt[j] * ls[j]").replace("lambda j", "lambda i").replace("[j]", "[i]") + ") - rt[j] * ls[j])")} AS wt FROM (
        SELECT series, h, w, lv2, sq, mx, {each("ls[j] + 0.5 * (rg[j] * (1 + rt[j] * rg[j]) + bd[j] * CASE WHEN rt[j] * rg[j] > 0.5 THEN 1.0 ELSE 0.0 END)")} AS ls, {each("least(1 / bd[j], sqrt(ln(5::DOUBLE) / greatest(sq[j], 1e-3)))")} AS rt FROM (
        SELECT *, {each("pow(2.0::DOUBLE, ceil(log2(mx[j] + 1e-3)) + 1)")} AS bd FROM (
        SELECT series, h, w, rt, ls, rg, lv2, {each("sq[j] + rg[j] * rg[j]")} AS sq, {each("greatest(mx[j], abs(rg[j]))")} AS mx FROM (
        SELECT *, {each("(CASE WHEN s > thr THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - 0.2::DOUBLE) * (lv[j] - level)")} AS rg,
            {each(f"least(greatest(lv[j] + {g}[j] * (0.2::DOUBLE - CASE WHEN s > {guarded} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0.0), 1.0)")} AS lv2 FROM r))))) ) st
        JOIN b n ON n.series = st.series AND n.h = st.h AND n.w = st.w + 1))
    SELECT series, w, h, {method}round(thr, 6) AS thr FROM r"""


def _dtaci_sql(score: str, method: str = "") -> str:
    """The experts' weighted mean, which draws nothing."""
    g = "[0.001::DOUBLE, 0.01::DOUBLE, 0.1::DOUBLE]"
    each = lambda f: f"list_transform(range(1, 4), lambda j: {f})"
    threes = lambda x: f"[{', '.join([x] * 3)}]"
    return f"""{sql.scored("user", score)},
    b AS (SELECT *, list_sort(list(s) OVER (PARTITION BY series, h ORDER BY w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) AS xs FROM scored),
    r AS (SELECT series, h, w, s, xs, {threes("0.2::DOUBLE")} AS lv, {threes("1.0::DOUBLE / 3")} AS ch, 0.2::DOUBLE AS used, {sql.quantile("xs", ALPHA)} AS thr FROM b WHERE w = 5
        UNION ALL
        SELECT series, h, w, s, xs, lv, ch, used, {sql.quantile("xs", "least(greatest(used, 0.0), 1.0)")} FROM (
        SELECT n.series, n.h, n.w, n.s, n.xs, lv2 AS lv, ch2 AS ch, list_sum({each("ch2[j] * lv2[j]")}) / list_sum(ch2) AS used FROM (
        SELECT *, {each("(1 - 1e-3) * wt[j] / list_sum(wt) + 1e-3 / 3")} AS ch2 FROM (
        SELECT *, {each("ch[j] * exp(-2.72::DOUBLE * lo[j])")} AS wt FROM (
        SELECT *, {each("0.2::DOUBLE * (rg - lv[j]) - least(rg - lv[j], 0.0)")} AS lo, {each(f"least(greatest(lv[j] + {g}[j] * (0.2::DOUBLE - CASE WHEN lv[j] > rg THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0.0), 1.0)")} AS lv2 FROM (
        SELECT *, len(list_filter(xs, lambda x: x > s)) / len(xs)::DOUBLE AS rg FROM r)))) st
        JOIN b n ON n.series = st.series AND n.h = st.h AND n.w = st.w + 1))
    SELECT series, w, h, {method}round(thr, 6) AS thr FROM r"""


@register("agaci", "WITH RECURSIVE " + _agaci_sql("abs"))
def agaci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn.online(user_scores(spark, sf_dir), KEYS, ALPHA, ("AgACI",), size=20).drop("method")


@register("dtaci", "WITH RECURSIVE " + _dtaci_sql("abs"))
def dtaci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn.online(user_scores(spark, sf_dir), KEYS, ALPHA, ("DtACI",), size=20, options={"DtACI": {"mean": True}}).drop("method")


@register("dtaci_drawn")
def dtaci_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of an expert that is drawn; no SQL has the generator."""
    return kn.online(user_scores(spark, sf_dir), KEYS, ALPHA, ("DtACI",), size=20)


@register("adaptive_cqr_kernels", f"SELECT * FROM (WITH RECURSIVE {_agaci_sql('cqr', chr(39) + 'AgACI' + chr(39) + ' AS method, ')}) UNION ALL SELECT * FROM (WITH RECURSIVE {_dtaci_sql('cqr', chr(39) + 'DtACI' + chr(39) + ' AS method, ')})")
def adaptive_cqr_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn.online(user_scores(spark, sf_dir, "cqr"), KEYS, ALPHA, ("AgACI", "DtACI"), size=20, options={"DtACI": {"mean": True}})


_BEFORE = "OVER (PARTITION BY series, h ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@register("spci_short", f"WITH {sql.panel('user')}, q AS (SELECT *, quantile_cont(y - yhat, 0.1) {_BEFORE} AS q_lo, quantile_cont(y - yhat, 0.9) {_BEFORE} AS q_up FROM panel) SELECT series, h, w, round(q_lo, 6) AS q_lo, round(q_up, 6) AS q_up FROM q WHERE split = 'test'")
def spci_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn.spci_bounds(_errors(spark, sf_dir), KEYS, ALPHA, w=100)


@register("spci_forest")
def spci_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn.spci_bounds(_errors(spark, sf_dir), KEYS, ALPHA, w=5, bins=5)


def _acmcp_sql() -> str:
    """Both tails without the forecast of the error: tracking from the calibration quantile, and the integrator."""
    frame = "OVER (PARTITION BY series, h ORDER BY w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
    angle = lambda side: f"CASE WHEN r.n > 1 THEN (r.m_{side} - r.n * 0.1::DOUBLE) * ln(r.n) / r.n ELSE 0.0 END"
    miss = {"lo": "CASE WHEN -r.e > greatest(r.q_lo, 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "up": "CASE WHEN r.e > greatest(r.q_up, 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"}
    moved = lambda side: f"r.t_{side} + 0.1::DOUBLE * r.spread * ({miss[side]} - 0.1::DOUBLE)"
    pulled = lambda side: f"{moved(side)} + CASE WHEN abs({angle(side)}) < pi() / 2 THEN r.ki * tan({angle(side)}) ELSE 0.0 END"
    high = lambda xs: f"{xs}[1 + CAST(ceil(0.9::DOUBLE * (len({xs}) - 1)) AS INT)]"
    return f"""WITH RECURSIVE {sql.panel("user")}, x AS (SELECT series, h, w, split, y - yhat AS e FROM panel),
    b AS (SELECT *, max(abs(e)) {frame} - min(abs(e)) {frame} AS spread FROM x),
    k AS (SELECT series, h, list_sort(list(e)) AS es, list_sort(list(-e)) AS ns, max(abs(e)) AS ki FROM x WHERE split = 'cal' GROUP BY series, h),
    r AS (SELECT b.*, ki, {high("ns")} AS t_lo, {high("es")} AS t_up, {high("ns")} AS q_lo, {high("es")} AS q_up, 0.0::DOUBLE AS m_lo, 0.0::DOUBLE AS m_up, 0.0::DOUBLE AS n FROM b JOIN k USING (series, h) WHERE w = 5
        UNION ALL SELECT nx.*, r.ki, {moved("lo")}, {moved("up")}, {pulled("lo")}, {pulled("up")}, r.m_lo + {miss["lo"]}, r.m_up + {miss["up"]}, r.n + 1 FROM r JOIN b nx ON nx.series = r.series AND nx.h = r.h AND nx.w = r.w + 1)
    SELECT series, w, h, round(greatest(q_lo, 0), 6) AS q_lo, round(greatest(q_up, 0), 6) AS q_up FROM r"""


@register("acmcp_tracking", _acmcp_sql())
def acmcp_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn.acmcp_bounds(_errors(spark, sf_dir), ["series"], ALPHA, scorecast=False)


@register("acmcp")
def acmcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn.acmcp_bounds(_errors(spark, sf_dir), ["series"], ALPHA)


EPOCHS, RATE = 25, 0.05  # of the registered fit; the operator's own are 500 and 0.01


def _adam_sql(steps: int = 4) -> str:
    """The fit by Adam over rank vectors, an epoch a recursion; then each step's linear quantile."""
    each = lambda f, sep=", ": sep.join(f(k) for k in range(steps))
    theta = lambda k: f"(1 / (1 + exp(-t{k})))"
    return f"""WITH RECURSIVE {_R}, po AS (SELECT series, w, row_number() OVER (ORDER BY w, series) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT series, w FROM cal)),
    lo AS (SELECT cal.*, pos, n FROM cal JOIN po USING (series, w)), e AS (SELECT h, list_sort(list(r)) AS es FROM lo WHERE pos < floor(0.6 * n) GROUP BY h),
    u AS (SELECT pos, h, len(list_filter(es, lambda x: x <= r)) / len(es) AS u FROM lo JOIN e USING (h) WHERE pos >= floor(0.6 * n)),
    v AS (SELECT {each(lambda k: f"max(u) FILTER (WHERE h = {k}) AS u{k}")} FROM u GROUP BY pos),
    a AS (SELECT 0 AS step, {each(lambda k: f"0.8::DOUBLE AS t{k}, 0.0::DOUBLE AS m{k}, 0.0::DOUBLE AS v{k}")}
        UNION ALL
        SELECT step + 1, {each(lambda k: f"least(greatest(t{k} - {RATE}::DOUBLE * (n{k} / (1 - pow(0.9::DOUBLE, step + 1))) / (sqrt(w{k}) / sqrt(1 - pow(0.999::DOUBLE, step + 1)) + 1e-8::DOUBLE), -6.0), 6.0), n{k}, w{k}")}
        FROM (SELECT *, {each(lambda k: f"0.9::DOUBLE * m{k} + 0.1::DOUBLE * g{k} AS n{k}, 0.999::DOUBLE * v{k} + 0.001::DOUBLE * g{k} * g{k} AS w{k}")}
            FROM (SELECT *, {each(lambda k: f"sign(c - 0.8::DOUBLE) * d{k} * {theta(k)} * (1 - {theta(k)}) AS g{k}")}
                FROM (SELECT step, {each(lambda k: f"t{k}, m{k}, v{k}")}, avg(p) AS c, {each(lambda k: f"avg(p * 20 * (1 - s{k})) AS d{k}")}
                    FROM (SELECT *, {each(lambda k: f"s{k}", " * ")} AS p FROM (SELECT a.*, {each(lambda k: f"1 / (1 + exp(-20 * ({theta(k)} - u{k}))) AS s{k}")} FROM a, v WHERE step < {EPOCHS}))
                    GROUP BY ALL)))),
    th AS ({each(lambda k: f"SELECT {k} AS h, {theta(k)} AS theta FROM a WHERE step = {EPOCHS}", " UNION ALL ")}),
    k AS (SELECT h, es, theta * (len(es) - 1) AS pos FROM e JOIN th USING (h))
    SELECT h, round(es[1 + CAST(floor(pos) AS INT)] + (es[least(2 + CAST(floor(pos) AS INT), len(es))] - es[1 + CAST(floor(pos) AS INT)]) * (pos - floor(pos)), 6) AS radius FROM k"""


@register("copula_adam", _adam_sql())
def copula_adam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probability for each step, fitted by gradients that are aggregates over all trajectories."""
    return cl.adam_radii(ps.user_panel(spark, sf_dir), ALPHA, epochs=EPOCHS, lr=RATE)


# Sources, splits, forecasters and streams ------------------------------------------------------------------------

from calibrant.functions import forecasters as fc  # noqa: E402
from calibrant.sources import files as fl  # noqa: E402
from calibrant.sources import datasets as dt  # noqa: E402
from calibrant.streaming.stateful import adaptive_levels, run_files  # noqa: E402
from calibrant.streaming.online import online_aci, run_available  # noqa: E402

_USER_ARRAYS = "SELECT CAST(user_id AS VARCHAR) AS item_id, min(ts) AS start, list(value ORDER BY ts, event_id) AS target FROM events GROUP BY user_id"


def user_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw dataset: a row per user with all values in order."""
    ev_ = ps.table(spark, sf_dir, "events")
    target = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"])
    return ev_.groupBy("user_id").agg(F.min("ts").alias("start"), target.alias("target")).select(F.col("user_id").cast("string").alias("item_id"), "start", F.lit("H").alias("freq"), "target")


@register("to_long_explode", f"WITH a AS ({_USER_ARRAYS}), e AS (SELECT item_id, start, target, unnest(range(1, len(target) + 1)) AS t FROM a) SELECT item_id AS series, CAST(t AS INT) AS t, start + to_hours(CAST(t - 1 AS INT)) AS ts, round(target[t], 6) AS target FROM e")
def to_long_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.to_long(dt.to_fev(user_arrays(spark, sf_dir), "H"))


@register("multivariate_split", "SELECT CAST(vec_id AS VARCHAR) || '_dim' || CAST(k AS VARCHAR) AS item_id, [CAST(embedding[k + 1] AS DOUBLE)] AS target FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS k FROM embeddings)")
def multivariate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = ps.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("item_id"), F.transform("embedding", lambda v: F.array(v.cast("double"))).alias("target"))
    return dt.univariate(raw)


@register("rolling_split", f"WITH a AS ({_USER_ARRAYS}), w AS (SELECT item_id, target, unnest(range(0, 3)) AS w FROM a) SELECT item_id, CAST(w AS INT) AS w, len(target) - 4 * (3 - w) AS n_input, round(list_sum(target[len(target) - 4 * (3 - w) + 1 : len(target) - 4 * (3 - w) + 4]), 6) AS label_sum FROM w WHERE len(target) - 4 * (3 - w) > 0")
def rolling_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, test = dt.splits(user_arrays(spark, sf_dir), 4, 3)
    return test.select("item_id", "w", F.size("input").cast("bigint").alias("n_input"), F.aggregate("label", F.lit(0.0), lambda s, v: s + v).alias("label_sum"))


@register("cal_test_split", f"WITH {sql.panel('user')} SELECT CASE WHEN w >= 5 THEN 'test' WHEN w >= 2 THEN 'cal' ELSE 'skip' END AS split, count(*) AS n FROM panel GROUP BY 1")
def cal_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.user_panel(spark, sf_dir).groupBy(ps.split_of("w", 5, 3).alias("split")).agg(F.count("*").alias("n"))


@register("dataset_stats", f"WITH a AS ({_USER_ARRAYS}) SELECT count(*) AS series, 1 AS dims, CAST(min(len(target)) AS INT) AS min_length, CAST(sum(len(target)) AS BIGINT) AS sum_length, 4 AS prediction_length, CAST(least(greatest(1, ceil(min(len(target)) * 0.1::DOUBLE / 4)), 20) AS INT) AS windows FROM a")
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.statistics(user_arrays(spark, sf_dir), 4)


@register("window_count_rule", f"WITH a AS ({_USER_ARRAYS}) SELECT item_id, CAST(least(greatest(1, ceil(len(target) * 0.1::DOUBLE / 2)), 20) AS INT) AS windows FROM a")
def window_count_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_arrays(spark, sf_dir).select("item_id", dt.window_count(F.size("target"), 2).alias("windows"))


@register("context_truncation", f"WITH a AS ({_USER_ARRAYS}) SELECT item_id, round(list_sum(target[greatest(len(target) - 15, 1) : len(target)]), 6) AS context_sum FROM a")
def context_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_arrays(spark, sf_dir).select("item_id", F.aggregate(dt.truncate(F.col("target"), 16), F.lit(0.0), lambda s, v: s + v).alias("context_sum"))


def _forecast_sql(point: str) -> str:
    return f"WITH a AS ({_USER_ARRAYS}), s AS (SELECT *, unnest(range(0, 4)) AS h, len(target) AS n FROM a) SELECT item_id, CAST(h AS INT) AS h, round({point}, 6) AS yhat FROM s"


for _name, _point in {"last": "target[n]", "seasonal_naive": "CASE WHEN n >= 24 THEN target[n - 24 + h % 24 + 1] ELSE target[n] END", "moving_average": "list_sum(target) / n", "drift": "target[n] + (h + 1) * coalesce((target[n] - target[1]) / nullif(n - 1, 0), 0)"}.items():
    register(f"forecast_{_name}", _forecast_sql(_point))(lambda s, d, n=_name: fc.predict(user_arrays(s, d).withColumnRenamed("target", "past"), n, 4).select("item_id", "h", "yhat"))


@register("error_metrics", f"WITH {sql.panel('user')} SELECT h, round(sum(abs(y - yhat)) / nullif(sum(abs(y)), 0), 6) AS wape, round(sum(2 * {sql.pinball('y')}) / nullif(sum(abs(y)), 0), 6) AS wql FROM panel WHERE split = 'test' GROUP BY h")
def error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.error_metrics(ps.user_panel(spark, sf_dir).where("split = 'test'"), ["h"])


# Stores, files and reports on the way through them ---------------------------------------------------------------

from calibrant.functions.scores import interval_fields  # noqa: E402
from calibrant.sources import store  # noqa: E402

_PANEL_SQL = f"WITH {sql.panel('user')} SELECT series, w, h, {sql.rounded('y, yhat, ' + sql.Q)}, split FROM panel"
_A = f"WITH a AS ({_USER_ARRAYS})"


@register("io_load", "SELECT n_nationkey, n_name, n_regionkey, true AS missing_is_none FROM nation")
def io_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset by its name under a root; nothing where there is none."""
    missing = dt.load(spark, sf_dir, "no-such-table", freq="H") is None
    return dt.load(spark, sf_dir, "nation.parquet").select("n_nationkey", "n_name", "n_regionkey", F.lit(missing).alias("missing_is_none"))


@register("io_formats", f"{_A} SELECT count(*) AS series, true AS gift_eval, true AS fev, false AS raw_is_fev, true AS same FROM a")
def io_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = user_arrays(spark, sf_dir)
    fev = dt.to_fev(raw, "H")
    flags = {"gift_eval": dt.is_gift_eval(raw), "fev": dt.is_fev(fev), "raw_is_fev": dt.is_fev(raw), "same": dt.to_fev(fev, "H") is fev}
    return fev.agg(F.count("*").alias("series")).select("series", *[F.lit(v).alias(k) for k, v in flags.items()])


@register("io_converted", f"{_A} SELECT count(*) AS series, round(sum(list_sum(target)), 3) AS total, 'H' AS freq FROM a", digits=3)
def io_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converted once, read from the cache the second time; the metadata of a frame says its frequency."""
    path = shared_path(spark, "converted")
    dt.converted(spark, user_arrays(spark, sf_dir), "H", path)
    again = dt.converted(spark, user_arrays(spark, sf_dir).limit(0), "H", path)
    freq = dt.meta(dt.with_meta(again, freq="H"))["freq"]
    total = F.sum(F.aggregate("target", F.lit(0.0), lambda s, v: s + v))
    return again.agg(F.count("*").alias("series"), total.alias("total")).withColumn("freq", F.lit(freq))


def _stored_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "panel")
    store.write_panel(ps.user_panel(spark, sf_dir).withColumn("task", F.lit("users")).withColumn("model", F.lit("baseline")), path)
    return store.read_panel(spark, path)


@register("io_panel_store", _PANEL_SQL)
def io_panel_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel written by model and task and read back by its fixed schema."""
    return flat(_stored_panel(spark, sf_dir).where("model = 'baseline' AND task = 'users'"))


@register("io_pruned_quantiles", f"WITH {sql.panel('user')} SELECT series, w, h, round(q10, 6) AS lo, round(q90, 6) AS hi FROM panel WHERE split = 'test' AND h = 1")
def io_pruned_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two levels that an interval needs, of one step: the other levels aren't read."""
    lo, hi = interval_fields(ALPHA)
    return _stored_panel(spark, sf_dir).where("split = 'test' AND h = 1").select("series", "w", "h", F.col(f"q.{lo}").alias("lo"), F.col(f"q.{hi}").alias("hi"))


def _wide(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions and truth as stores have them: a row for each window and series, arrays by step, a column per level."""
    steps = F.sort_array(F.collect_list(F.struct("h", "y", "yhat", "q")))
    rows = panel.groupBy("w", F.col("series").alias("item_id")).agg(steps.alias("s"))
    of = lambda f: F.transform("s", f)
    level = lambda f: of(lambda x: x["q"][f]).alias(f"{int(f[1:]) / 100:g}")
    levels = [level(f) for f in FIELDS]
    return rows.select("w", "item_id", of(lambda x: x["yhat"]).alias("predictions"), *levels), rows.select("w", "item_id", of(lambda x: x["y"]).alias("target"))


@register("io_import_windows", _PANEL_SQL)
def io_import_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of predictions and truth joined into a panel by window, series and step."""
    return flat(store.import_windows(*_wide(ps.user_panel(spark, sf_dir)), "users", "baseline", ps.USER["cal"]))


@register("io_window_dirs", f"WITH {sql.panel('user')} SELECT w, count(*) AS n, round(max(yhat), 6) AS largest FROM panel WHERE w < 3 AND h = 0 GROUP BY w")
def io_window_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each window, found by number."""
    path = shared_path(spark, "windows")
    wide = _wide(ps.user_panel(spark, sf_dir).where("w < 3"))[0]
    for w in range(3):
        wide.where(F.col("w") == w).drop("w").write.parquet(f"{path}/window_{w}/predictions")
    rows = store.read_window_dirs(spark, path, "predictions")
    return rows.join(store.discover_windows(rows), "w").groupBy("w").agg(F.count("*").alias("n"), F.max(F.get("predictions", 0)).alias("largest"))


@register("io_unified", _PANEL_SQL)
def io_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each window with all its series, taken apart and imported."""
    pred, true = _wide(ps.user_panel(spark, sf_dir))
    gather = lambda df: df.groupBy("w").agg(F.sort_array(F.collect_list(F.struct("item_id", *[F.col(f"`{c}`") for c in df.columns if c not in ("w", "item_id")]))).alias("s"))
    spread = lambda df, cols: gather(df).select("w", *[F.col("s").getField(c).alias(c) for c in ["item_id", *cols]])
    levels = [c for c in pred.columns if c not in ("w", "item_id")]
    return flat(store.import_windows(store.unified_windows(spread(pred, levels)), store.unified_windows(spread(true, ["target"])), "users", "baseline", ps.USER["cal"]))


@register("io_cached", f"{_A} SELECT item_id, CAST(len(target) AS INT) AS n, round(list_sum(target[greatest(len(target) - 7, 1) : len(target)]), 6) AS total FROM a")
def io_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts kept by a digest of their parameters: the second call doesn't build."""
    root = shared_path(spark, "cache")
    context = lambda: user_arrays(spark, sf_dir).select("item_id", F.size("target").alias("n"), dt.truncate(F.col("target"), 8).alias("past"))
    store.cached(spark, root, context, context=8)
    again = store.cached(spark, root, lambda: 1 / 0, context=8)
    return again.select("item_id", "n", F.aggregate("past", F.lit(0.0), lambda s, v: s + v).alias("total"))


@register("io_metadata", "SELECT 'users' AS task_name, 4::BIGINT AS horizon, count(DISTINCT user_id) AS num_series FROM events")
def io_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side-car files of tasks, found at any depth; those without test windows stay out."""
    path = shared_path(spark, "metadata")
    n = ps.table(spark, sf_dir, "events").agg(F.countDistinct("user_id")).first()[0]
    store.write_metadata(spark, f"{path}/m/users/metadata", task_name="users", horizon=4, num_series=n, test_windows=3)
    store.write_metadata(spark, f"{path}/m/none/metadata", task_name="none", horizon=4, num_series=n, test_windows=0)
    return store.read_metadata(spark, path).select("task_name", "horizon", "num_series")


@register("io_metadata_shapes", "SELECT event_type AS task_name, count(DISTINCT user_id) AS num_series, count(*) AS n_rows FROM events GROUP BY event_type")
def io_metadata_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side-car files whose keys and types differ: a number or its text, a figure or an object that holds it."""
    path = shared_path(spark, "documents")
    tasks = ps.table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("s"), F.count("*").alias("n"))
    name = F.col("event_type").alias("task_name")
    plain = F.to_json(F.struct(name, F.col("s").alias("num_series"), F.col("n").alias("evaluation")))
    deep = F.to_json(F.struct(name, F.col("s").cast("string").alias("num_series"), F.struct(F.col("n").alias("rows")).alias("evaluation")))
    text = F.when(F.crc32(F.col("event_type").cast("binary")) % 2 == 0, deep).otherwise(plain)
    tasks.select(F.col("event_type").alias("task"), text.alias("text")).write.mode("overwrite").partitionBy("task").text(path)
    fields = {"task_name": (("$.task_name",), "string"), "num_series": (("$.num_series",), "bigint"), "n_rows": (("$.evaluation.rows", "$.evaluation"), "bigint")}
    return store.read_documents(spark, path, fields, "*.txt").drop("file")


_RESULT_SCHEMA = "task string, model string, method string, coverage double, avg_width double"


@register("io_results", f"WITH {_RES} SELECT task, model, method, round(coverage, 6) AS coverage, round(avg_width, 6) AS avg_width, 0.2::DOUBLE AS alpha, model AS score FROM (SELECT task, 'abs' AS model, method, coverage, avg_width FROM res WHERE model = 'mean' UNION ALL SELECT task, 'cqr', method, coverage, avg_width FROM res WHERE model = 'median')")
def io_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files with other columns, in another order and under older names, read as one frame with the parameters
    from their names."""
    path, rows = shared_path(spark, "results"), results(spark, sf_dir)
    store.write_csv(rows.where("model = 'mean'").select("task", F.lit("abs").alias("model"), "method", "coverage", "avg_width"), path, store.result_name("cp", 0.2, "abs", -1, "marginal"))
    store.write_csv(rows.where("model = 'median'").select(F.col("avg_width").alias("width"), "method", F.lit("cqr").alias("model"), F.col("coverage").alias("coverage_mean"), "task"), path, store.result_name("cp", 0.2, "cqr", 5, "marginal"))
    return store.read_results(spark, path, _RESULT_SCHEMA)


@register("io_dashboard", f"WITH {_RES} SELECT CAST(count(DISTINCT model) AS INT) AS models, CAST(count(DISTINCT task) AS INT) AS tasks, round(sum(coverage), 6) AS coverage FROM res")
def io_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's document, read back."""
    rows = results(spark, sf_dir)
    doc = store.dashboard(rows.groupBy("model").agg(F.sum("coverage").alias("coverage")), rows.groupBy("task").agg(F.avg("coverage").alias("coverage")), rows.select("task", "n_series").distinct())
    shape = "model_summaries array<struct<model:string,coverage:double>>, task_summaries array<struct<task:string,coverage:double>>, tasks_metadata array<struct<task:string,n_series:bigint>>"
    got = doc.select(F.from_json("document", shape).alias("d"))
    return got.select(F.size("d.model_summaries").alias("models"), F.size("d.tasks_metadata").alias("tasks"), F.aggregate("d.model_summaries", F.lit(0.0), lambda s, x: s + x["coverage"]).alias("coverage"))


@register("cal_extension", f"{_A}, m AS (SELECT min(len(target)) // 2 - 2 - 1 AS fit FROM a), n AS (SELECT CASE WHEN least(fit, 12) >= 10 THEN least(fit, 12) ELSE 0 END AS cal FROM m), w AS (SELECT item_id, len(target) AS len, cal, unnest(range(0, CASE WHEN cal = 0 THEN 0 ELSE cal + 2 END)) AS w FROM a, n) SELECT item_id, CAST(w AS INT) AS w, CASE WHEN w < cal THEN 'cal' ELSE 'test' END AS split, CAST(len - 2 * (cal + 2 - w) AS INT) AS n_input FROM w WHERE len - 2 * (cal + 2 - w) > 0")
def cal_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two test windows of two steps, and up to twelve calibration windows before them."""
    return dt.extended(user_arrays(spark, sf_dir), 2, 2, 12).select("item_id", "w", "split", F.size("input").alias("n_input"))


@register("context_scan", f"{_A} SELECT count(*) AS num_series, CAST(max(len(target)) - 8 AS INT) AS max_context, 4 AS horizon FROM a")
def context_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.context_scan(user_arrays(spark, sf_dir), 4, 2)


@register("left_padded", f"{_A} SELECT item_id, CAST(greatest(40 - len(target), 0) AS INT) AS lack, round(list_sum(target[greatest(len(target) - 39, 1) : len(target)]), 6) AS total, 40 AS n, round(greatest(40 - len(target), 0) * target[greatest(len(target) - 39, 1)], 6) AS before FROM a")
def left_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of one length: gaps before them are filled with the first value there is."""
    padded = user_arrays(spark, sf_dir).select("item_id", dt.left_padded(F.col("target"), 40).alias("x")).withColumn("f", dt.filled(F.col("x")))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    lack = F.size(F.filter("x", lambda v: v.isNull()))
    return padded.select("item_id", lack.alias("lack"), total("x").alias("total"), F.size("f").alias("n"), (total("f") - total("x")).alias("before"))


@register("covariates_only", f"WITH {sql.panel('hourly')} SELECT series, count(*) AS n FROM panel WHERE series > (SELECT min(series) FROM panel) GROUP BY series")
def covariates_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.chosen_series(ps.hourly_panel(spark, sf_dir), "covariates_only").groupBy("series").agg(F.count("*").alias("n"))


@register("asym_metrics", f"WITH {_tails_sql('cqr')}, {sql.split_thr(ALPHA / 2, 'series, h, tail')}, pair AS (SELECT series, w, h, any_value(y) AS y, any_value(ql) AS ql, any_value(qh) AS qh, max(thr) FILTER (WHERE tail = 'lo') AS a, max(thr) FILTER (WHERE tail = 'up') AS b FROM thr GROUP BY series, w, h), iv AS (SELECT *, ql - a AS lo, qh + b AS hi FROM pair), {sql.marked()}, {sql.horizon_metrics()} SELECT h, {sql.rounded('coverage, avg_width, winkler_score')} FROM mh")
def asym_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of quantile intervals whose sides move by themselves."""
    rows = sc.scored(ps.user_panel(spark, sf_dir), "cqr", ALPHA, KEYS[:1], asymmetric=True)
    return mt.by_horizon(mt.marks(interval(cp.both_tails(cp.split_cp, rows, KEYS, ALPHA, carry=("y", "yhat", "q")), "cqr"), ALPHA)).drop("frac_infinite")


@register("clamped", f"{_A}, s AS (SELECT *, unnest(range(0, 4)) AS h, len(target) AS n FROM a), f AS (SELECT item_id, h, target[n] + (h + 1) * coalesce((target[n] - target[1]) / nullif(n - 1, 0), 0) AS p, list_min(target) AS low FROM s) SELECT item_id, CAST(h AS INT) AS h, round(CASE WHEN low >= 0 THEN greatest(p, 0) ELSE p END, 6) AS yhat FROM f")
def clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift that doesn't fall below 0 where the past never did."""
    return fc.predict(user_arrays(spark, sf_dir).withColumnRenamed("target", "past"), "drift", 4, non_negative=True).select("item_id", "h", "yhat")


@register("batched_model", f"{_A}, s AS (SELECT *, unnest(range(0, 3)) AS h FROM a) SELECT item_id, CAST(h AS INT) AS h, round(list_sum(target) / len(target) + h, 6) AS yhat, round(list_min(target), 6) AS low FROM s")
def batched_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of Python over batches of pasts; batches of over 16 don't fit and are halved."""
    import numpy as np

    def model(pasts, horizon):
        if len(pasts) > 16:
            raise MemoryError
        points = np.array([[x.mean() + h for h in range(horizon)] for x in pasts])
        return points, np.stack([np.full((horizon, len(FIELDS)), x.min()) for x in pasts])

    got = fc.predict_with(user_arrays(spark, sf_dir).withColumnRenamed("target", "past"), model, 3, batch=50, keys=("item_id",))
    return got.select("item_id", "h", "yhat", F.col("q.q10").alias("low"))


@register("scaled_errors", f"WITH {sql.panel('user')}, g AS (SELECT series, avg(abs(y - before)) AS scale FROM (SELECT series, y, lag(y) OVER (PARTITION BY series ORDER BY t) AS before FROM steps) WHERE before IS NOT NULL GROUP BY series) SELECT h, round(sum(abs(y - yhat)) / sum(abs(y)), 6) AS wape, round(sum(2 * {sql.pinball('y')}) / sum(abs(y)), 6) AS wql, round(avg(abs(y - yhat) / scale), 6) AS mase, round(avg(2 * {sql.pinball('y')} / scale), 6) AS sql FROM panel JOIN g USING (series) WHERE split = 'test' GROUP BY h")
def scaled_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors in units of each series' mean step."""
    scales = user_arrays(spark, sf_dir).select(F.col("item_id").alias("series"), fc.seasonal_scale(F.col("target"), 1).alias("scale"))
    return fc.error_metrics(ps.user_panel(spark, sf_dir).where("split = 'test'").join(scales, "series"), ["h"], "scale")


report("native_once", "SELECT task, model, method FROM res WHERE method <> 'Native' OR model = 'mean'")(lambda r: rp.native_once(r, ["task"], ["model"]).select("task", "model", "method"))
report("runtime_totals", "SELECT method, CAST(sum(n_series) AS DOUBLE) AS runtime FROM res GROUP BY method")(lambda r: rp.runtime_totals(r.withColumn("runtime", F.col("n_series").cast("double"))))
report("by_category", "SELECT method, CASE WHEN method = 'Native' THEN 'long' ELSE 'short' END AS horizon_category, count(*) AS n, row_number() OVER (ORDER BY CASE WHEN method = 'Native' THEN 'long' ELSE 'short' END DESC, method) AS place FROM res GROUP BY method")(
    lambda r: rp.by_category(r.groupBy("method", F.when(F.col("method") == "Native", "long").otherwise("short").alias("horizon_category")).agg(F.count("*").alias("n")), ["method"]).withColumn("place", F.monotonically_increasing_id() + 1).limit(100)
)
report("shown", "SELECT task, model, method, CASE WHEN coverage IS NULL THEN 'N/A' WHEN coverage < 0.01 THEN printf('%.3e', coverage) ELSE printf('%.3f', coverage) END AS coverage, CASE WHEN avg_width < 0.01 THEN printf('%.3e', avg_width) WHEN avg_width < 100 THEN printf('%.3f', avg_width) ELSE printf('%.1f', avg_width) END AS avg_width, 'N/A' AS none FROM res")(lambda r: r.select("task", "model", "method", rp.shown("coverage").alias("coverage"), rp.shown("avg_width").alias("avg_width"), rp.shown(F.lit(None).cast("double")).alias("none")))
report("filter_patterns", "SELECT task, model, method FROM res WHERE regexp_matches(method, '^(Split|Trail)') AND coverage IS NOT NULL AND n_series <= 1000")(lambda r: rp.filtered(r, method__like="^(Split|Trail)", coverage__there=True, n_series__le=1000).select("task", "model", "method"))
report("search_rows", "SELECT task, model, method FROM res WHERE contains(lower(method), 'win') OR contains(lower(model), 'win') OR contains(lower(task), 'win')")(lambda r: rp.filtered(r, search="WIN", columns=("task", "model", "method")).select("task", "model", "method"))
report("tidy_rows", "SELECT method, round_even(coverage, 2) AS coverage, 0.2::DOUBLE AS alpha, CAST(n_series AS DOUBLE) AS runtime, task, model FROM res")(lambda r: rp.tidy(r.select("method", "coverage", F.col("n_series").cast("double").alias("runtime"), "avg_width", "task", "model"), {"alpha": 0.2}, 2, drop=("avg_width",)))


def _fed(scores: DataFrame, base: str, files: int = 4) -> None:
    """The scores as files in order of windows: each file's windows follow those of the file before."""
    last = scores.agg(F.max("w")).first()[0] or 0
    for k in range(files):
        own = scores.where((F.col("w") > (last + 1) * k // files - 1) & (F.col("w") <= (last + 1) * (k + 1) // files - 1))
        own.coalesce(1).write.mode("append").parquet(f"{base}/in")


def _stream(spark: SparkSession, sf_dir: str, gamma: float) -> DataFrame:
    """Scores as a file stream, a start for each of four parts of the windows, through the online state of each series and
    step; the result as it was written. A part's files are written by many tasks, so it isn't a file, but what has come
    since the start before."""
    base, parts = shared_path(spark, "stream"), 4
    scores = stored(user_scores(spark, sf_dir).select(*KEYS, F.col("w").cast("bigint").alias("w"), "s"), "scores")
    last = scores.agg(F.max("w")).first()[0] or 0
    for k in range(parts):
        own = scores.where((F.col("w") > (last + 1) * k // parts - 1) & (F.col("w") <= (last + 1) * (k + 1) // parts - 1))
        own.write.mode("append").parquet(f"{base}/in")
        out = online_aci(spark.readStream.schema(scores.schema).parquet(f"{base}/in"), KEYS, ALPHA, gamma, 20, test_from=ps.USER["cal"])
        made = run_available(out, f"{base}/out", f"{base}/state")
    return made.select(*KEYS, F.col("w").cast("int").alias("w"), F.round("thr", 6).alias("thr"), F.round("alpha_t", 6).alias("alpha_t"))


@register("stream_levels", _aci_sql(sql.scored("weekly", "abs"), ALPHA, 0.05, 20, pick="series, h, w, round(thr, 3) AS thr, round(a, 6) AS alpha_t", first=40))
def stream_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly panel's scores in micro-batches of windows, by a stateful processor with timers."""
    base = shared_path(spark, "levels")
    rows = sc.scored(ps.weekly_panel(spark, sf_dir), "abs", ALPHA, KEYS[:1]).select(*KEYS, F.col("w").cast("bigint").alias("w"), "s")
    rows = rows.withColumn("at", F.timestamp_seconds(F.col("w") * 604_800)).withColumn("reset", F.lit(False))
    _fed(rows, base, 3)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    out = adaptive_levels(source, KEYS, ALPHA, 0.05, 20, test_from=ps.WEEKLY["cal"], idle=10 * 604_800)
    return run_files(out, f"{base}/out", f"{base}/state").where("late = 0").select(*KEYS, F.col("w").cast("int").alias("w"), F.round("thr", 3).alias("thr"), F.round("alpha_t", 6).alias("alpha_t"))


for _name, _gamma in {"stream_aci": 0.05, "stream_trailing": 0.0}.items():
    register(_name, _aci_sql(sql.scored("user", "abs"), ALPHA, _gamma, 20, pick="series, h, w, round(thr, 6) AS thr, round(a, 6) AS alpha_t"))(lambda s, d, g=_gamma: _stream(s, d, g))


# Runners over several methods ------------------------------------------------------------------------------------


@register("run_kernels")
def run_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.run(ps.user_panel(spark, sf_dir), ev.EvalConfig(methods=("AgACI", "DtACI", "SPCI", "AcMCP"), window=20))


_METHOD_SUMMARY = f"""{sql.marked()}, {sql.horizon_metrics(by="method")},
    jc AS (SELECT method, avg(CAST(a AS INT)::DOUBLE) AS joint_coverage FROM (SELECT method, series, w, bool_and(coalesce(covered = 1, false)) AS a FROM mk GROUP BY ALL) GROUP BY method),
    su AS (SELECT method, avg(coverage) AS coverage, avg(avg_width) AS avg_width, avg(winkler_score) AS winkler_score FROM mh GROUP BY method)"""
_SCALED = """, nv AS (SELECT avg_width AS nw, winkler_score AS nk FROM su WHERE method = 'Native')
    SELECT method, round(coverage, 6) AS coverage, round(avg_width, 6) AS avg_width, round(winkler_score, 6) AS winkler_score, round(joint_coverage, 6) AS joint_coverage,
        round(avg_width / CASE WHEN nw > 1e-8 THEN nw ELSE 1 END, 6) AS scaled_width, round(winkler_score / CASE WHEN nk > 1e-8 THEN nk ELSE 1 END, 6) AS scaled_winkler FROM su JOIN jc USING (method), nv"""
_NATIVE_IV = "SELECT 'Native' AS method, series, w, h, y, q10 AS lo, q90 AS hi FROM base WHERE split = 'test'"


@register("run_joint", f"""WITH {_R}, x AS (SELECT h, list_sort(list(r)) AS xs FROM cal GROUP BY h),
    sg AS (SELECT h, CASE WHEN avg(r) >= 1e-8 THEN avg(r) ELSE 1 END AS sigma FROM cal GROUP BY h), m AS (SELECT list_sort(list(m)) AS xs FROM (SELECT max(r / sigma) AS m FROM cal JOIN sg USING (h) GROUP BY series, w)),
    rad AS (SELECT 'JointCFRNN' AS method, h, {sql.quantile("xs", ALPHA / 4)} AS radius FROM x UNION ALL SELECT 'NormMaxCP', h, sigma * {sql.quantile("xs", ALPHA)} FROM sg, m),
    iv AS (SELECT method, series, w, h, y, yhat - radius AS lo, yhat + radius AS hi FROM panel JOIN rad USING (h) WHERE split = 'test'), {_METHOD_SUMMARY}
    SELECT method, round(coverage, 6) AS coverage, round(avg_width, 6) AS avg_width, round(winkler_score, 6) AS winkler_score, round(joint_coverage, 6) AS joint_coverage FROM su JOIN jc USING (method)""")
def run_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.run_joint(ps.user_panel(spark, sf_dir), ev.EvalConfig(methods=("JointCFRNN", "NormMaxCP")))


@register("run_joint_all")
def run_joint_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every joint method with the operator's own parameters: Adam goes through all of its epochs."""
    return ev.run_joint(ps.user_panel(spark, sf_dir), ev.EvalConfig(methods=tuple(ev.JOINT)))


@register("joint_cv", f"""WITH {sql.scored("user", "abs")}, p AS (SELECT *, {_fold_sql(5)} AS fold FROM scored),
    t AS (SELECT g.fold, h, list_sort(list(s)) AS xs FROM p JOIN (SELECT unnest(range(0, 5)) AS fold) g ON g.fold <> p.fold GROUP BY g.fold, h),
    iv AS (SELECT p.*, yhat - {sql.quantile("xs", ALPHA / 4)} AS lo, yhat + {sql.quantile("xs", ALPHA / 4)} AS hi FROM p JOIN t ON p.fold = t.fold AND p.h = t.h), {sql.marked()}, {sql.horizon_metrics(by="fold")},
    jc AS (SELECT fold, avg(CAST(a AS INT)::DOUBLE) AS joint_coverage FROM (SELECT fold, series, w, bool_and(coalesce(covered = 1, false)) AS a FROM mk GROUP BY ALL) GROUP BY fold)
    SELECT fold, round(avg(coverage), 6) AS coverage, round(avg(avg_width), 6) AS avg_width, round(avg(winkler_score), 6) AS winkler_score, round(any_value(joint_coverage), 6) AS joint_coverage FROM mh JOIN jc USING (fold) GROUP BY fold""")
def joint_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.run_joint_folds(ps.user_panel(spark, sf_dir), 5, ALPHA).drop("method")


@register("cv_methods", f"""WITH {sql.scored("user", "abs")}, p AS (SELECT *, {_fold_sql(5)} AS own FROM scored),
    x AS (SELECT p.*, g.fold, CASE WHEN own = g.fold THEN 'test' ELSE 'cal' END AS role FROM p, (SELECT unnest(range(0, 5)) AS fold) g),
    fr AS (SELECT *, list_sort(list(s) FILTER (WHERE role = 'cal') OVER (PARTITION BY fold, h)) AS cs, list_sort(list(s) OVER (PARTITION BY fold, h ORDER BY role, w, series ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) AS xs FROM x),
    t AS (SELECT * FROM fr WHERE role = 'test'),
    iv AS (SELECT 'Native' AS method, fold, series, w, h, y, q10 AS lo, q90 AS hi FROM t
        UNION ALL SELECT 'SplitCP', fold, series, w, h, y, yhat - {sql.quantile("cs", ALPHA)}, yhat + {sql.quantile("cs", ALPHA)} FROM t
        UNION ALL SELECT 'TrailingWindow', fold, series, w, h, y, yhat - {sql.quantile("xs", ALPHA, False)}, yhat + {sql.quantile("xs", ALPHA, False)} FROM t),
    {sql.marked()}, {sql.horizon_metrics(by="fold, method")},
    jc AS (SELECT fold, method, avg(CAST(a AS INT)::DOUBLE) AS joint_coverage FROM (SELECT fold, method, series, w, bool_and(coalesce(covered = 1, false)) AS a FROM mk GROUP BY ALL) GROUP BY ALL),
    su AS (SELECT fold, method, avg(coverage) AS coverage, avg(avg_width) AS avg_width, avg(winkler_score) AS winkler_score FROM mh GROUP BY ALL)
    SELECT method, round(avg(coverage), 6) AS coverage, round(avg(avg_width), 6) AS avg_width, round(avg(winkler_score), 6) AS winkler_score, round(avg(joint_coverage), 6) AS joint_coverage FROM su JOIN jc USING (fold, method) GROUP BY method""")
def cv_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validation over series of a static and a learning method, averaged over folds."""
    return ev.fold_average(ev.run_folds(ps.user_panel(spark, sf_dir), ev.EvalConfig(methods=("SplitCP", "TrailingWindow"), window=20), 5))


@register("run_tasks", f"""WITH {sql.scored("user", "abs")}, {sql.split_thr()}, iv AS (SELECT 't' || CAST(CAST(series AS INT) % 4 AS VARCHAR) AS task, * FROM ({_NATIVE_IV} UNION ALL SELECT 'SplitCP', series, w, h, y, yhat - thr, yhat + thr FROM thr)),
    {sql.marked()}, {sql.horizon_metrics(by="task, method")},
    jc AS (SELECT task, method, avg(CAST(a AS INT)::DOUBLE) AS joint_coverage FROM (SELECT task, method, series, w, bool_and(coalesce(covered = 1, false)) AS a FROM mk GROUP BY ALL) GROUP BY ALL),
    su AS (SELECT task, method, avg(coverage) AS coverage, avg(avg_width) AS avg_width, avg(winkler_score) AS winkler_score FROM mh GROUP BY ALL),
    nv AS (SELECT task, avg_width AS nw, winkler_score AS nk FROM su WHERE method = 'Native')
    SELECT task, method, round(coverage, 6) AS coverage, round(avg_width, 6) AS avg_width, round(winkler_score, 6) AS winkler_score, round(joint_coverage, 6) AS joint_coverage, round(avg_width / nw, 6) AS scaled_width, round(winkler_score / nk, 6) AS scaled_winkler
    FROM su JOIN jc USING (task, method) JOIN nv USING (task)""")
def run_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several tasks at once: each has its own rows and its own Native."""
    panel = ps.user_panel(spark, sf_dir).withColumn("task", F.concat(F.lit("t"), F.pmod(F.col("series").cast("int"), F.lit(4)).cast("string")))
    return ev.run(panel, ev.EvalConfig(methods=("SplitCP",)), ("task", "series"))


_SPLIT_IV = f"iv AS ({_NATIVE_IV} UNION ALL SELECT 'SplitCP', series, w, h, y, yhat - thr, yhat + thr FROM thr)"


@register("run_log_fallback", f"WITH {sql.scored('user', 'abs')}, {sql.split_thr()}, {_SPLIT_IV}, {_METHOD_SUMMARY}{_SCALED}")
def run_log_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values far below 0 have no log score, so abs is used, whose intervals move with the values."""
    shift = lambda c: (F.col(c) - 1000).alias(c.rpartition(".")[2])
    panel = ps.user_panel(spark, sf_dir).select("series", "w", "h", shift("y"), shift("yhat"), F.struct(*[shift(f"q.{f}") for f in FIELDS]).alias("q"), "split")
    return ev.run(panel, ev.EvalConfig(score="log", methods=("SplitCP",)))


@register("run_cal_windows", f"WITH {sql.scored('user', 'abs')}, {sql.split_thr(source='(SELECT * FROM scored WHERE w >= 2)')}, {_SPLIT_IV}, {_METHOD_SUMMARY}{_SCALED}")
def run_cal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three calibration windows alone."""
    return ev.run(ps.user_panel(spark, sf_dir), ev.EvalConfig(methods=("SplitCP",), cal_windows=3, min_cal_windows=2))


def _single_sql(frozen: bool) -> str:
    xs = "list_sort(list(s) OVER (PARTITION BY series ORDER BY w * 4 + h ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"
    held = "first_value(xs) OVER (PARTITION BY series, w ORDER BY h)" if frozen else "xs"
    return f"""WITH {sql.scored("user", "abs")}, fr AS (SELECT *, {xs} AS xs FROM scored), t AS (SELECT * REPLACE ({held} AS xs) FROM fr WHERE split = 'test'),
    iv AS ({_NATIVE_IV} UNION ALL SELECT 'TrailingWindow', series, w, h, y, yhat - {sql.quantile("xs", ALPHA, False)}, yhat + {sql.quantile("xs", ALPHA, False)} FROM t), {_METHOD_SUMMARY}{_SCALED}"""


for _name, _online in {"single_step_run": True, "single_step_run_frozen": False}.items():
    register(_name, _single_sql(not _online))(lambda s, d, o=_online: ev.run_single_step(ps.user_panel(s, d), ev.EvalConfig(methods=("TrailingWindow",), window=20), 4, online=o))


def _pid_tails_sql(score: str) -> str:
    """Quantile tracking of each tail at half of alpha, from the calibration quantile on."""
    by = "PARTITION BY series, h, tail"
    spread = f"max(s) OVER ({by} ORDER BY w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) - min(s) OVER ({by} ORDER BY w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
    return f"""WITH RECURSIVE {_tails_sql(score)}, {sql.split_thr(ALPHA / 2, "series, h, tail")}, b AS (SELECT *, {spread} AS spread FROM scored),
    x AS (SELECT b.series, b.h, b.tail, b.w, b.s, b.spread, thr.thr AS q0 FROM b JOIN thr ON b.series = thr.series AND b.h = thr.h AND b.tail = thr.tail AND b.w = thr.w),
    r AS (SELECT *, q0 AS thr FROM x WHERE w = 5
        UNION ALL SELECT n.*, r.thr - 0.1::DOUBLE * r.spread * (0.1::DOUBLE - CASE WHEN r.s > r.thr THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM r JOIN x n ON n.series = r.series AND n.h = r.h AND n.tail = r.tail AND n.w = r.w + 1)
    SELECT {PAIR} FROM r GROUP BY series, w, h"""


@register("pid_asym", _pid_tails_sql("cqr"))
def pid_asym(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sc.scored(ps.user_panel(spark, sf_dir), "cqr", ALPHA, KEYS[:1], asymmetric=True)
    return cp.both_tails(cp.pid, rows, KEYS, ALPHA, size=20)


# Several tasks and models at once, long keys, kept results -------------------------------------------------------


def _two_models(panel: DataFrame) -> DataFrame:
    """The panel's series in two tasks, each of two models: the mean forecast and the median one."""
    task = F.when(F.col("series").cast("int") % 2 == 0, "even").otherwise("odd")
    models = F.inline(F.array(F.struct(F.lit("mean").alias("model"), F.col("yhat").alias("p")), F.struct(F.lit("median").alias("model"), F.col("q.q50").alias("p"))))
    return panel.select(task.alias("task"), "series", "w", "h", "y", "q", "split", models).withColumnRenamed("p", "yhat")


_TWO = f"""{sql.panel("user")}, pm AS (SELECT CASE WHEN CAST(series AS INT) % 2 = 0 THEN 'even' ELSE 'odd' END AS task, model, * REPLACE (CASE model WHEN 'mean' THEN yhat ELSE q50 END AS yhat) FROM panel, (VALUES ('mean'), ('median')) m(model)),
    scored AS (SELECT *, abs(y - yhat) AS s FROM pm)"""
_GROUPED = f"""{sql.marked()}, {sql.horizon_metrics(by="{by}")},
    jc AS (SELECT {{by}}, avg(CAST(a AS INT)::DOUBLE) AS joint_coverage FROM (SELECT {{by}}, series, w, bool_and(coalesce(covered = 1, false)) AS a FROM mk GROUP BY ALL) GROUP BY ALL),
    su AS (SELECT {{by}}, avg(coverage) AS coverage, avg(avg_width) AS avg_width, avg(winkler_score) AS winkler_score FROM mh GROUP BY ALL)"""
_KEYED = ("task", "model", "series")
_MEANS = "round(coverage, 6) AS coverage, round(avg_width, 6) AS avg_width, round(winkler_score, 6) AS winkler_score, round(joint_coverage, 6) AS joint_coverage"
_BY_NATIVE = f"""nv AS (SELECT task, model, avg_width AS nw, winkler_score AS nk FROM su WHERE method = 'Native')
    SELECT task, model, method, {_MEANS}, round(avg_width / CASE WHEN nw > 1e-8 THEN nw ELSE 1 END, 6) AS scaled_width, round(winkler_score / CASE WHEN nk > 1e-8 THEN nk ELSE 1 END, 6) AS scaled_winkler FROM su JOIN jc USING (task, model, method) JOIN nv USING (task, model)"""
_ALONG = "OVER (PARTITION BY task, model, series ORDER BY w * 4 + h ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@register("keyed_single_step", f"""WITH {_TWO}, fr AS (SELECT *, list_sort(list(s) {_ALONG}) AS xs FROM scored),
    iv AS (SELECT 'Native' AS method, task, model, series, w, h, y, q10 AS lo, q90 AS hi FROM fr WHERE split = 'test'
        UNION ALL SELECT 'TrailingWindow', task, model, series, w, h, y, yhat - {sql.quantile("xs", ALPHA, False)}, yhat + {sql.quantile("xs", ALPHA, False)} FROM fr WHERE split = 'test'),
    {_GROUPED.replace("{by}", "task, model, method")}, {_BY_NATIVE}""")
def keyed_single_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One state a series, in each task and model."""
    return ev.run_single_step(_two_models(ps.user_panel(spark, sf_dir)), ev.EvalConfig(methods=("TrailingWindow",), window=20), keys=_KEYED)


@register("keyed_joint", f"""WITH {_TWO}, cal AS (SELECT * FROM scored WHERE split = 'cal'), x AS (SELECT task, model, h, list_sort(list(s)) AS xs FROM cal GROUP BY ALL),
    sg AS (SELECT task, model, h, CASE WHEN avg(s) >= 1e-8 THEN avg(s) ELSE 1 END AS sigma FROM cal GROUP BY ALL),
    m AS (SELECT task, model, list_sort(list(m)) AS xs FROM (SELECT task, model, max(s / sigma) AS m FROM cal JOIN sg USING (task, model, h) GROUP BY task, model, series, w) GROUP BY ALL),
    rad AS (SELECT 'JointCFRNN' AS method, task, model, h, {sql.quantile("xs", ALPHA / 4)} AS radius FROM x UNION ALL SELECT 'NormMaxCP', task, model, h, sigma * {sql.quantile("xs", ALPHA)} FROM sg JOIN m USING (task, model)),
    iv AS (SELECT method, task, model, series, w, h, y, yhat - radius AS lo, yhat + radius AS hi FROM scored JOIN rad USING (task, model, h) WHERE split = 'test'),
    {_GROUPED.replace("{by}", "task, model, method")} SELECT task, model, method, {_MEANS} FROM su JOIN jc USING (task, model, method)""")
def keyed_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint methods, in each task and model."""
    return ev.run_joint(_two_models(ps.user_panel(spark, sf_dir)), ev.EvalConfig(methods=("JointCFRNN", "NormMaxCP")), _KEYED)


@register("keyed_folds", f"""WITH {_TWO}, p AS (SELECT *, {_fold_sql(5)} AS fold FROM scored),
    t AS (SELECT task, model, g.fold, h, list_sort(list(s)) AS xs FROM p JOIN (SELECT unnest(range(0, 5)) AS fold) g ON g.fold <> p.fold GROUP BY ALL),
    iv AS (SELECT 'Native' AS method, task, model, fold, series, w, h, y, q10 AS lo, q90 AS hi FROM p
        UNION ALL SELECT 'SplitCP', task, model, fold, series, w, h, y, yhat - {sql.quantile("xs", ALPHA)}, yhat + {sql.quantile("xs", ALPHA)} FROM p JOIN t USING (task, model, fold, h)
        UNION ALL SELECT 'CFRNN', task, model, fold, series, w, h, y, yhat - {sql.quantile("xs", ALPHA / 4)}, yhat + {sql.quantile("xs", ALPHA / 4)} FROM p JOIN t USING (task, model, fold, h)),
    {_GROUPED.replace("{by}", "task, model, fold, method")} SELECT task, model, fold, method, {_MEANS} FROM su JOIN jc USING (task, model, fold, method)""")
def keyed_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validation over series, in each task and model."""
    return ev.run_folds(_two_models(ps.user_panel(spark, sf_dir)), ev.EvalConfig(methods=("SplitCP", "CFRNN")), 5, keys=_KEYED)


@register("keyed_joint_folds", f"""WITH {_TWO}, p AS (SELECT *, {_fold_sql(5)} AS fold FROM scored),
    t AS (SELECT task, model, g.fold, h, list_sort(list(s)) AS xs FROM p JOIN (SELECT unnest(range(0, 5)) AS fold) g ON g.fold <> p.fold GROUP BY ALL),
    iv AS (SELECT 'JointCFRNN' AS method, task, model, fold, series, w, h, y, yhat - {sql.quantile("xs", ALPHA / 4)} AS lo, yhat + {sql.quantile("xs", ALPHA / 4)} AS hi FROM p JOIN t USING (task, model, fold, h)),
    {_GROUPED.replace("{by}", "task, model, fold, method")} SELECT task, model, fold, method, {_MEANS} FROM su JOIN jc USING (task, model, fold, method)""")
def keyed_joint_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint methods across series, in each task and model."""
    return ev.run_joint_folds(_two_models(ps.user_panel(spark, sf_dir)), 5, ALPHA, keys=_KEYED)


_WALK = f"""{sql.scored("user", "abs")}, p AS (SELECT *, {_fold_sql(5)} AS own FROM scored),
    x AS (SELECT p.* EXCLUDE (split), g.fold, CASE WHEN own = g.fold THEN 'test' ELSE 'cal' END AS split FROM p, (SELECT unnest(range(0, 5)) AS fold) g),
    walk AS (SELECT *, row_number() OVER (PARTITION BY fold, h ORDER BY split, w, series) AS pos, count(*) FILTER (WHERE split = 'cal') OVER (PARTITION BY fold, h) + 1 AS first_pos FROM x)"""


@register("fold_walk_aci", f"""WITH RECURSIVE {_WALK},
    b AS (SELECT fold, h, series, w, s, pos, first_pos, list_sort(list(s) OVER (PARTITION BY fold, h ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) AS xs FROM walk),
    r AS (SELECT b.*, 0.2::DOUBLE AS a, {sql.quantile("xs", ALPHA)} AS thr FROM b WHERE pos = first_pos
        UNION ALL
        SELECT *, {sql.quantile("xs", "a")} AS thr FROM (SELECT n.*, least(greatest(r.a + 0.05::DOUBLE * (0.2::DOUBLE - CASE WHEN r.s > r.thr THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0.0), 1.0) AS a FROM r JOIN b n ON r.fold = n.fold AND r.h = n.h AND n.pos = r.pos + 1))
    SELECT fold, h, series, w, round(thr, 6) AS thr, round(a, 6) AS alpha_t FROM r""")
def fold_walk_aci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive thresholds along each fold's windows and series, in segments of 200 steps."""
    rows = fd.fold_sequences(user_scores(spark, sf_dir), 5, 42, 20)
    return sg.scan(rows, ["fold", "h"], sg.Adaptive(ALPHA, 20, 0.05), ["split", "w", "series"], segment=200).select("fold", "h", "series", "w", "thr", "alpha_t")


@register("fold_walk_pid", f"""WITH RECURSIVE {_WALK},
    cw AS (SELECT fold, h, list_sort(list(s)) AS xs FROM walk WHERE split = 'cal' GROUP BY ALL),
    b AS (SELECT fold, h, series, w, s, pos, first_pos, max(s) OVER f - min(s) OVER f AS spread FROM walk WINDOW f AS (PARTITION BY fold, h ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    r AS (SELECT b.*, {sql.quantile("xs", ALPHA)} AS thr FROM b JOIN cw USING (fold, h) WHERE pos = first_pos
        UNION ALL SELECT n.*, r.thr - 0.1::DOUBLE * r.spread * (0.2::DOUBLE - CASE WHEN r.s > r.thr THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM r JOIN b n ON n.fold = r.fold AND n.h = r.h AND n.pos = r.pos + 1)
    SELECT fold, h, series, w, round(thr, 6) AS thr FROM r""")
def fold_walk_pid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked thresholds along each fold, from the other folds' quantile on."""
    rows = fd.split_cp_folds(user_scores(spark, sf_dir), ALPHA, 5).withColumnRenamed("thr", "q0").drop("fold")
    return sg.scan(fd.fold_sequences(rows, 5, 42, 20), ["fold", "h"], sg.Tracking(ALPHA, 20), ["split", "w", "series"], extra="q0", segment=500).select("fold", "h", "series", "w", "thr")


@register("segments_trailing", f"""WITH {_FLAT}, fr AS (SELECT *, list_sort(list(s) OVER (PARTITION BY h ORDER BY w, series ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) AS xs FROM scored)
    SELECT series, w, h, round({sql.quantile("xs", ALPHA, False)}, 6) AS thr FROM fr WHERE split = 'test'""")
def segments_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key a step, over all series: segments of 300 scores, each behind the 20 before it."""
    return sg.scan(user_scores(spark, sf_dir), ["h"], sg.Trailing(ALPHA, 20), ["w", "series"], segment=300).select("series", "w", "h", "thr")


@register("past_quantiles_pooled", f"""WITH {_FLAT}, fr AS (SELECT *, list_sort(list(s) OVER (PARTITION BY h ORDER BY w * 1000000 + CAST(series AS BIGINT) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS xs FROM scored)
    SELECT series, w, h, round({sql.quantile("xs", ALPHA)}, 6) AS thr FROM fr WHERE split = 'test'""")
def past_quantiles_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantile of all scores of a step before each row, over all series: counts by blocks of 500 rows."""
    rows = user_scores(spark, sf_dir).withColumn("at", F.col("w").cast("bigint") * 1_000_000 + F.col("series").cast("bigint"))
    return rk.past_quantiles(rows, ["h"], ALPHA, order="at", carry=("series", "w"), block=500).select("series", "w", "h", "thr")


_CACHED = f"""{_TWO}, cq AS (SELECT task, model, series, h, list_sort(list(s)) AS xs FROM scored WHERE split = 'cal' GROUP BY ALL),
    fr AS (SELECT *, list_sort(list(s) OVER (PARTITION BY task, model, series, h ORDER BY w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) AS ts FROM scored),
    t AS (SELECT * FROM fr LEFT JOIN cq USING (task, model, series, h) WHERE split = 'test'),
    iv AS (SELECT 'Native' AS method, task, model, series, w, h, y, q10 AS lo, q90 AS hi FROM t
        UNION ALL SELECT 'SplitCP', task, model, series, w, h, y, yhat - {sql.quantile("xs", ALPHA)}, yhat + {sql.quantile("xs", ALPHA)} FROM t
        UNION ALL SELECT 'CFRNN', task, model, series, w, h, y, yhat - {sql.quantile("xs", ALPHA / 4)}, yhat + {sql.quantile("xs", ALPHA / 4)} FROM t
        UNION ALL SELECT 'TrailingWindow', task, model, series, w, h, y, yhat - {sql.quantile("ts", ALPHA, False)}, yhat + {sql.quantile("ts", ALPHA, False)} FROM t),
    {_GROUPED.replace("{by}", "task, model, method")}, {_BY_NATIVE}"""


@register("run_cached", f"WITH {_CACHED}".replace(f"{_MEANS}, round(avg_width / CASE", f"{_MEANS}, method = 'CFRNN' AS computed, round(avg_width / CASE"))
def run_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run with one more method: only that is computed, the others' metrics are read."""
    base = shared_path(spark, "evaluated")
    store.write_panel(_two_models(ps.user_panel(spark, sf_dir)), f"{base}/panel")
    config = ev.EvalConfig(methods=("SplitCP", "TrailingWindow"), window=20)
    ch.run_cached(spark, f"{base}/panel", config, f"{base}/results")
    return ch.run_cached(spark, f"{base}/panel", replace(config, methods=("SplitCP", "CFRNN", "TrailingWindow")), f"{base}/results")


def _sweep_sql() -> str:
    """Two levels, three scores, two trailing windows and two numbers of calibration windows."""
    low, high = ("CASE alpha WHEN 0.2 THEN q10 ELSE q20 END", "CASE alpha WHEN 0.2 THEN q90 ELSE q80 END")
    s = "CASE score WHEN 'abs' THEN abs(y - yhat) WHEN 'squared' THEN (y - yhat) * (y - yhat) ELSE greatest(nlo - y, y - nhi) END"
    at = lambda xs, correction: f"CASE alpha WHEN 0.2 THEN {sql.quantile(xs, 0.2, correction)} ELSE {sql.quantile(xs, 0.4, correction)} END"
    side = lambda sign, q: f"CASE score WHEN 'abs' THEN yhat {sign} thr WHEN 'squared' THEN yhat {sign} sqrt(greatest(thr, 0.0)) ELSE {q} {sign} thr END"
    ok = "isfinite(lo) AND isfinite(hi) AND y IS NOT NULL"
    by = "alpha, score, cal_windows, win, method"
    return f"""WITH {sql.panel("user")}, x AS (SELECT *, {low} AS nlo, {high} AS nhi FROM panel, (SELECT unnest([0.2::DOUBLE, 0.4::DOUBLE]) AS alpha), (SELECT unnest(['abs', 'squared', 'cqr']) AS score)),
    sd AS (SELECT *, {s} AS s FROM x),
    fr AS (SELECT *, list_sort(list(s) FILTER (WHERE split = 'cal') OVER k) AS c_all, list_sort(list(s) FILTER (WHERE split = 'cal' AND w >= 2) OVER k) AS c_3,
        list_sort(list(s) OVER (PARTITION BY series, h, alpha, score ORDER BY w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) AS p_5,
        list_sort(list(s) OVER (PARTITION BY series, h, alpha, score ORDER BY w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) AS p_20 FROM sd WINDOW k AS (PARTITION BY series, h, alpha, score)),
    co AS (SELECT fr.*, cal_windows, win, CASE cal_windows WHEN 3 THEN c_3 ELSE c_all END AS cs, CASE win WHEN 5 THEN p_5 ELSE p_20 END AS ts FROM fr, (VALUES (-1), (3)) a(cal_windows), (VALUES (5), (20)) b(win) WHERE split = 'test'),
    th AS (SELECT *, 'SplitCP' AS method, {at("cs", True)} AS thr FROM co UNION ALL SELECT *, 'TrailingWindow', {at("ts", False)} FROM co),
    iv AS (SELECT {by}, series, w, h, y, {side("-", "nlo")} AS lo, {side("+", "nhi")} AS hi FROM th UNION ALL SELECT alpha, score, cal_windows, win, 'Native', series, w, h, y, nlo, nhi FROM co),
    mk AS (SELECT *, CASE WHEN {ok} THEN CAST(y >= lo AND y <= hi AS INT)::DOUBLE END AS covered, CASE WHEN {ok} THEN hi - lo END AS width, CASE WHEN {ok} THEN hi - lo + (2 / alpha) * greatest(lo - y, y - hi, 0.0) END AS winkler FROM iv),
    {sql.horizon_metrics(by=by)},
    jc AS (SELECT {by}, avg(CAST(a AS INT)::DOUBLE) AS joint_coverage FROM (SELECT {by}, series, w, bool_and(coalesce(covered = 1, false)) AS a FROM mk GROUP BY ALL) GROUP BY ALL),
    su AS (SELECT {by}, avg(coverage) AS coverage, avg(avg_width) AS avg_width, avg(winkler_score) AS winkler_score FROM mh GROUP BY ALL),
    nv AS (SELECT alpha, score, cal_windows, win, avg_width AS nw, winkler_score AS nk FROM su WHERE method = 'Native')
    SELECT alpha, score, cal_windows, win AS "window", method, {_MEANS}, round(avg_width / CASE WHEN nw > 1e-8 THEN nw ELSE 1 END, 6) AS scaled_width, round(winkler_score / CASE WHEN nk > 1e-8 THEN nk ELSE 1 END, 6) AS scaled_winkler
    FROM su JOIN jc USING ({by}) JOIN nv USING (alpha, score, cal_windows, win)"""


@register("run_sweep", _sweep_sql())
def run_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations from one read of the panel and one sort of each key."""
    config = ev.EvalConfig(methods=("SplitCP", "TrailingWindow"))
    return ev.run_sweep(ps.user_panel(spark, sf_dir), (0.2, 0.4), ("abs", "squared", "cqr"), config, windows=(5, 20), cal_windows=(-1, 3))


@register("io_arrow_source", f"{_A} SELECT item_id, CAST(len(target) AS INT) AS n, round(list_sum(target), 6) AS total FROM a")
def io_arrow_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series as Arrow files, and back by many tasks a file, without the columns that aren't asked for."""
    path = shared_path(spark, "arrow-files")
    fl.write_arrow(user_arrays(spark, sf_dir).drop("start"), path).agg(F.sum("rows")).collect()
    rows = fl.read_arrow(spark, path, columns=["item_id", "target"])
    return rows.select("item_id", F.size("target").alias("n"), F.aggregate("target", F.lit(0.0), lambda s, v: s + v).alias("total"))
