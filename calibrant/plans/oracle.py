"""DuckDB SQL that gives the same rows as the registered queries: building blocks."""

from __future__ import annotations

from calibrant.functions.stats import FIELDS, LEVELS
from calibrant.sources.panels import HOURLY, USER, WEEKLY

Q = ", ".join(FIELDS)

STEPS = {
    "user": "SELECT CAST(user_id AS VARCHAR) AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value AS y FROM events",
    "hourly": """
        SELECT g.series, row_number() OVER (PARTITION BY g.series ORDER BY g.hour) AS t, s.y
        FROM (SELECT DISTINCT event_type AS series, hour FROM events, (SELECT unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) AS hour FROM events)) g
        LEFT JOIN (SELECT event_type AS series, date_trunc('hour', ts) AS hour, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS y FROM events GROUP BY 1, 2) s
        ON g.series = s.series AND g.hour = s.hour""",
    "weekly": """
        SELECT g.series, row_number() OVER (PARTITION BY g.series ORDER BY g.week) AS t, coalesce(s.y, 0) AS y
        FROM (SELECT DISTINCT wk0.series, k.week FROM wk0, (SELECT unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS week FROM wk0) k) g
        LEFT JOIN wk0 s ON g.series = s.series AND g.week = s.week""",
}
BEFORE = {
    "user": "",
    "hourly": "",
    "weekly": """wk0 AS (SELECT n_name AS series, CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS week,
        CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS y
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2), """,
}
SHAPE = {"user": USER, "hourly": HOURLY, "weekly": WEEKLY}


def panel(kind: str, cal: int | None = None) -> str:
    """CTEs up to panel(series, w, h, y, yhat, q10.., split)."""
    c, h = SHAPE[kind]["context"], SHAPE[kind]["horizon"]
    cal = SHAPE[kind]["cal"] if cal is None else cal
    grid = ", ".join(f"xs[1 + CAST(ceil({t}::DOUBLE * (len(xs) - 1)) AS INT)] AS {f}" for t, f in zip(LEVELS, FIELDS))
    return f"""{BEFORE[kind]}steps AS ({STEPS[kind]}),
    c AS (SELECT series, t, y, count(*) OVER (PARTITION BY series) AS n, list(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN {c - 1} PRECEDING AND CURRENT ROW) AS past FROM steps),
    o AS (SELECT series, (t - {c}) // {h} AS w, list_sort(list_filter(past, lambda x: x IS NOT NULL)) AS xs FROM c WHERE t >= {c} AND (t - {c}) % {h} = 0),
    f AS (SELECT series, w, round(list_sum(xs) / nullif(len(xs), 0), 6) AS yhat, {grid} FROM o),
    panel AS (SELECT c.series, CAST(f.w AS INT) AS w, CAST((c.t - 1 - {c}) % {h} AS INT) AS h, c.y, f.yhat, {Q}, CASE WHEN f.w >= {cal} THEN 'test' ELSE 'cal' END AS split
        FROM c JOIN f ON c.series = f.series AND (c.t - 1 - {c}) // {h} = f.w WHERE c.t > {c} AND {c} + {h} * (f.w + 1) <= c.n)"""


def level(n: str, alpha: str | float) -> str:
    a = f"{alpha}::DOUBLE" if isinstance(alpha, float) else alpha
    return f"least(ceil(({n} + 1) * (1 - {a})) / {n}, 1.0)"


def quantile(xs: str, alpha: str | float, correction: bool = True) -> str:
    """Conformal quantile of a sorted list."""
    a = f"{alpha}::DOUBLE" if isinstance(alpha, float) else alpha
    lvl = level(f"len({xs})", alpha) if correction else f"(1 - {a})"
    return f"(CASE WHEN coalesce(len({xs}), 0) = 0 THEN 'inf'::DOUBLE ELSE {xs}[1 + CAST(ceil(least(greatest({lvl}, 0.0), 1.0) * (len({xs}) - 1)) AS INT)] END)"


def _safe(x: str, fallback: str) -> str:
    return f"(CASE WHEN {x} > 1e-8 AND isfinite({x}) THEN {x} WHEN {fallback} > 1e-8 AND isfinite({fallback}) THEN {fallback} ELSE 1.0 END)"


#: scales(h, iqr_floor, rho_mad, sigma_lo, sigma_hi) from panel, for the interval q10 to q90.
SCALES = f"""mid AS (SELECT h, median(greatest(q90 - q10, 1e-8)) AS iqr, median(y - yhat) AS mr, median(q10 - y) AS ma, median(y - q90) AS mb FROM panel WHERE split = 'cal' GROUP BY h),
    dev AS (SELECT p.h, any_value(iqr) AS iqr, median(abs(y - yhat - mr)) * 1.4826 AS dr, median(abs(q10 - y - ma)) * 1.4826 AS da, median(abs(y - q90 - mb)) * 1.4826 AS db
        FROM panel p JOIN mid ON p.h = mid.h WHERE split = 'cal' GROUP BY p.h),
    sc1 AS (SELECT *, {_safe("iqr", "1.0")} AS iqr_floor FROM dev),
    sc2 AS (SELECT *, {_safe("dr", "iqr_floor")} AS rho_mad FROM sc1),
    scales AS (SELECT h, iqr_floor, rho_mad, {_safe("da", "rho_mad")} AS sigma_lo, {_safe("db", "rho_mad")} AS sigma_hi FROM sc2)"""

#: base: panel with scales, prev, the running maxima m1 to m9 of the grid, and the interval's lo and hi.
BASE = f"""{SCALES},
    pv AS (SELECT *, coalesce(lag(y - yhat) OVER (PARTITION BY series, h ORDER BY w), 0) AS prev FROM panel),
    base AS (SELECT pv.*, iqr_floor, rho_mad, sigma_lo, sigma_hi, q10 AS ql, q90 AS qh, {_safe("(q90 - q10)", "iqr_floor")} AS iqr_scale,
        {", ".join(f"greatest({', '.join(FIELDS[: k + 1])}) AS m{k + 1}" if k else "q10 AS m1" for k in range(9))} FROM pv JOIN scales USING (h))"""


def pinball(v: str) -> str:
    return "((" + " + ".join(f"CASE WHEN {v} >= {f} THEN {t}::DOUBLE * ({v} - {f}) ELSE (1 - {t}::DOUBLE) * ({f} - {v}) END" for t, f in zip(LEVELS, FIELDS)) + ") / 9)"


def cdf(y: str) -> str:
    t = [f"{x}::DOUBLE" for x in LEVELS]
    out = f"CASE WHEN {y} IS NULL THEN NULL WHEN {y} > m9 THEN least(greatest({t[8]} + ({t[8]} - {t[7]}) / greatest(m9 - m8, 1e-8) * ({y} - m9), {t[8]}), 1.0) WHEN {y} = m9 THEN {t[8]}"
    for k in range(7, -1, -1):
        out += f" WHEN {y} = m{k + 1} THEN {t[k]} WHEN {y} > m{k + 1} THEN {t[k]} + ({t[k + 1]} - {t[k]}) * ({y} - m{k + 1}) / greatest(m{k + 2} - m{k + 1}, 1e-8)"
    return f"({out} ELSE least(greatest({t[0]} + ({t[1]} - {t[0]}) / greatest(m2 - m1, 1e-8) * ({y} - m1), 0.0), {t[0]}) END)"


def grid_quantile(p: str) -> str:
    t = [f"{x}::DOUBLE" for x in LEVELS]
    out = f"CASE WHEN {p} >= {t[8]} THEN m9 + (m9 - m8) * ({p} - {t[8]}) / ({t[8]} - {t[7]})"
    for k in range(7, -1, -1):
        out += f" WHEN {p} >= {t[k]} THEN m{k + 1} + (m{k + 2} - m{k + 1}) * ({p} - {t[k]}) / ({t[k + 1]} - {t[k]})"
    return f"({out} ELSE m1 + (m2 - m1) * ({p} - {t[0]}) / ({t[1]} - {t[0]}) END)"


SCORE = {
    "abs": "abs(y - yhat)",
    "squared": "(y - yhat) * (y - yhat)",
    "signed": "y - yhat",
    "iqr_scaled": "abs(y - yhat) / iqr_scale",
    "mad_scaled": "abs(y - yhat) / rho_mad",
    "cqr": "greatest(ql - y, y - qh)",
    "scaled_cqr": "greatest((ql - y) / sigma_lo, (y - qh) / sigma_hi)",
    "distributional": f"{pinball('y')} - list_min([{', '.join(pinball(f) for f in FIELDS)}])",
    "cdf_tail": f"greatest(0.1::DOUBLE - {cdf('y')}, {cdf('y')} - 0.9::DOUBLE, 0.0)",
    "log": "CASE WHEN y + 1e-6 > 0 AND yhat + 1e-6 > 0 THEN abs(ln(greatest(y + 1e-6, 1e-300)) - ln(greatest(yhat + 1e-6, 1e-300))) END",
    "diff": "abs(y - yhat - prev)",
}


def _lines(side: str) -> str:
    """Where each support line of the mean pinball loss reaches the target."""
    out = []
    for f in FIELDS:
        op = "<=" if side == "hi" else "<"
        slope = "((" + " + ".join(f"CASE WHEN {g} {op} {f} THEN {t}::DOUBLE ELSE {t}::DOUBLE - 1 END" for t, g in zip(LEVELS, FIELDS)) + ") / 9)"
        test = "> 1e-12" if side == "hi" else "< -1e-12"
        out.append(f"CASE WHEN {slope} {test} THEN {f} + (target - {pinball(f)}) / {slope} END")
    return f"list_{'min' if side == 'hi' else 'max'}([{', '.join(out)}])"


BOUNDS = {
    "abs": ("yhat - thr", "yhat + thr"),
    "squared": ("yhat - sqrt(greatest(thr, 0.0))", "yhat + sqrt(greatest(thr, 0.0))"),
    "iqr_scaled": ("yhat - thr * iqr_scale", "yhat + thr * iqr_scale"),
    "mad_scaled": ("yhat - thr * rho_mad", "yhat + thr * rho_mad"),
    "cqr": ("ql - thr", "qh + thr"),
    "scaled_cqr": ("ql - thr * sigma_lo", "qh + thr * sigma_hi"),
    "distributional": (_lines("lo"), _lines("hi")),
    "cdf_tail": (grid_quantile("greatest(0.0, 0.1::DOUBLE - thr)"), grid_quantile("least(1.0, 0.9::DOUBLE + thr)")),
    "log": ("exp(ln(yhat + 1e-6) - thr) - 1e-6", "exp(ln(yhat + 1e-6) + thr) - 1e-6"),
    "diff": ("yhat + prev - thr", "yhat + prev + thr"),
}
SIGNED = {
    "abs": ("yhat - y", "y - yhat"),
    "signed": ("yhat - y", "y - yhat"),
    "cqr": ("ql - y", "y - qh"),
    "scaled_cqr": ("(ql - y) / sigma_lo", "(y - qh) / sigma_hi"),
    "diff": ("-(y - yhat - prev)", "y - yhat - prev"),
}


def scored(kind: str, score: str, cal: int | None = None) -> str:
    """CTEs up to scored: base and s."""
    return f"{panel(kind, cal)}, {BASE}, scored AS (SELECT *, {SCORE[score]} AS s FROM base)"


def split_thr(alpha: float = 0.2, by: str = "series, h", source: str = "scored") -> str:
    """thr: test rows of scored with their static threshold."""
    return f"""calq AS (SELECT {by}, list_sort(list(s) FILTER (WHERE s IS NOT NULL)) AS xs FROM {source} WHERE split = 'cal' GROUP BY {by}),
    thr AS (SELECT t.*, {quantile("xs", alpha)} AS thr FROM {source} t LEFT JOIN calq USING ({by}) WHERE split = 'test')"""


def bounded(score: str, source: str = "thr", name: str = "iv") -> str:
    lo, hi = BOUNDS[score]
    inner = source if score != "distributional" else f"(SELECT *, list_min([{', '.join(pinball(f) for f in FIELDS)}]) + greatest(thr, 0.0) AS target FROM {source})"
    return f"{name} AS (SELECT *, {lo} AS lo, {hi} AS hi FROM {inner})"


def marked(source: str = "iv", alpha: float = 0.2, name: str = "mk") -> str:
    ok = "isfinite(lo) AND isfinite(hi) AND y IS NOT NULL"
    return f"""{name} AS (SELECT *, CASE WHEN {ok} THEN CAST(y >= lo AND y <= hi AS INT)::DOUBLE END AS covered, CASE WHEN {ok} THEN hi - lo END AS width,
        CASE WHEN {ok} THEN hi - lo + (2 / {alpha}::DOUBLE) * greatest(lo - y, y - hi, 0.0) END AS winkler FROM {source})"""


def horizon_metrics(source: str = "mk", name: str = "mh", by: str = "") -> str:
    b = f"{by}, " if by else ""
    whole = lambda c: f"CASE WHEN count({c}) = count(*) THEN avg({c}) END"
    return f"""{name}s AS (SELECT {b}series, h, avg(covered) AS c, avg(width) AS wd, avg(winkler) AS wk FROM {source} GROUP BY {b}series, h),
    {name} AS (SELECT {b}h, {whole("c")} AS coverage, {whole("wd")} AS avg_width, {whole("wk")} AS winkler_score FROM {name}s GROUP BY {b}h)"""


def rounded(columns: str, digits: int = 6) -> str:
    """round() for each of the named columns."""
    return ", ".join(f"round({c.strip()}, {digits}) AS {c.strip()}" for c in columns.split(","))
