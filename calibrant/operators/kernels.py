"""Calibrators whose state doesn't fit a fold: NumPy kernels over one sorted key, run over sorted Arrow batches, a block of keys at a time.

Every kernel is a pure function of arrays; scores that aren't finite change no
state, but still get a threshold. Random choices are seeded by the key, so a
repeated or moved task gives the same rows. Several methods can share one pass.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator
from itertools import accumulate
from math import ceil, exp, isfinite, log, log2, pi, sqrt, tan

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def order_quantile(buf: np.ndarray, alpha: float) -> float:
    """Corrected 'higher' order statistic of finite scores at level 1 - alpha, alpha in [0, 1]."""
    n = len(buf)
    if n == 0:
        return INF
    level = min(max(np.ceil((n + 1) * (1 - alpha)) / n, 0.0), 1.0)
    return float(np.sort(buf)[int(np.ceil(level * (n - 1)))])


class Trailing:
    """The last `size` finite scores, by time and by rank."""

    def __init__(self, scores: np.ndarray, size: int):
        self.size = size
        self.time = deque(scores[np.isfinite(scores)][-size:].tolist())
        self.ranked = sorted(self.time)

    def __len__(self) -> int:
        return len(self.ranked)

    def add(self, s: float) -> None:
        if len(self.time) == self.size:
            del self.ranked[bisect_left(self.ranked, self.time.popleft())]
        self.time.append(s)
        insort(self.ranked, s)

    def quantile(self, alpha: float) -> float:
        """Corrected 'higher' order statistic at level 1 - alpha, alpha in [0, 1]."""
        n = len(self.ranked)
        if not n:
            return INF
        level = min(max(ceil((n + 1) * (1 - alpha)) / n, 0.0), 1.0)
        return self.ranked[ceil(level * (n - 1))]

    def share_over(self, s: float) -> float:
        """Share of the scores that exceed s; 1 without any."""
        n = len(self.ranked)
        return (n - bisect_right(self.ranked, s)) / n if n else 1.0

    def guarded(self, alpha: float) -> float:
        """Uncorrected quantile; infinity while there are too few scores for the level."""
        n = len(self.ranked)
        if not n or n < ceil(1 / max(alpha, 1e-9)):
            return INF
        return self.ranked[min(ceil(min(max(1 - alpha, 0.0), 1.0) * (n - 1)), n - 1)]


def agaci(cal: np.ndarray, test: np.ndarray, alpha: float, gammas: tuple[float, ...] = (0.001, 0.005, 0.01, 0.05, 0.1), size: int = 100, eps: float = 1e-3) -> np.ndarray:
    """Experts of several learning rates, weighted by their own second-order loss; the level used is their mean."""
    seen, k = Trailing(cal, size), len(gammas)
    levels, share = [alpha] * k, [1 / k] * k
    rate, squares, largest, loss = [0.0] * k, [0.0] * k, [0.0] * k, [0.0] * k
    out = np.empty(len(test))
    for t, s in enumerate(test.tolist()):
        level = min(max(sum(p * a for p, a in zip(share, levels)), 0.0), 1.0)
        out[t] = q = seen.quantile(level)
        if not isfinite(s):
            continue
        slope = float(s > q) - alpha
        for j in range(k):
            regret = slope * (levels[j] - level)
            squares[j] += regret * regret
            largest[j] = max(largest[j], abs(regret))
            bound = 2.0 ** (ceil(log2(largest[j] + eps)) + 1)
            loss[j] += 0.5 * (regret * (1 + rate[j] * regret) + bound * (rate[j] * regret > 0.5))
            rate[j] = min(1 / bound, sqrt(log(k) / max(squares[j], eps)))
        least = min(r * x for r, x in zip(rate, loss))
        weights = [r * exp(least - r * x) for r, x in zip(rate, loss)]
        total = sum(weights)
        share = [w / total for w in weights] if total > 0 else [1 / k] * k
        for j, g in enumerate(gammas):
            levels[j] = min(max(levels[j] + g * (alpha - float(s > seen.guarded(levels[j]))), 0.0), 1.0)
        seen.add(s)
    return out


def dtaci(cal: np.ndarray, test: np.ndarray, alpha: float, gammas: tuple[float, ...] = (0.001, 0.01, 0.1), sigma: float = 1e-3, eta: float = 2.72, size: int = 100, seed: int = 0, lookback: int | None = None, mean: bool = False) -> np.ndarray:
    """Experts under exponential weights of the pinball loss of the level that would just have covered, shared out a
    little at every step. The level used is a drawn expert's, or with mean=True the experts' weighted mean, which draws
    nothing. lookback adapts eta to the expected losses of so many steps."""
    seen, k = Trailing(cal, size), len(gammas)
    draws = np.random.default_rng(seed)
    levels, chances, used = [alpha] * k, [1 / k] * k, alpha
    recent: deque[float] = deque(maxlen=lookback or 1)
    out = np.empty(len(test))
    for t, s in enumerate(test.tolist()):
        out[t] = seen.quantile(min(max(used, 0.0), 1.0))
        if not isfinite(s):
            continue
        right = seen.share_over(s)
        losses = [alpha * (right - a) - min(right - a, 0.0) for a in levels]
        recent.append(sum(p * x for p, x in zip(chances, losses)))
        if lookback and len(recent) == lookback and (energy := sum(x * x for x in recent)) > 0:
            eta = sqrt((log(2 * k * lookback) + 1) / energy)
        levels = [min(max(a + g * (alpha - float(a > right)), 0.0), 1.0) for a, g in zip(levels, gammas)]
        logs = [log(p) - eta * x if p > 0 else -INF for p, x in zip(chances, losses)]
        top = max(logs)
        tilted = [exp(x - top) for x in logs]
        total = sum(tilted)
        chances = [(1 - sigma) * w / total + sigma / k for w in tilted]
        if mean:
            used = sum(p * a for p, a in zip(chances, levels)) / sum(chances)
        else:
            used = levels[min(bisect_right(list(accumulate(chances)), draws.random() * sum(chances)), k - 1)]
        seen.add(s)
    return out


class QuantileForest:
    """Bagged regression trees of small depth whose leaves keep all targets; quantiles of the pooled leaves."""

    def __init__(self, trees: int = 10, depth: int = 2, seed: int = 0):
        self.trees, self.depth, self.seed = trees, depth, seed

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        if depth == 0 or len(y) < 4:
            return y
        best = None
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            xs, ys = x[order, j], y[order]
            c, c2 = np.cumsum(ys), np.cumsum(ys**2)
            n = np.arange(1, len(ys))
            cost = (c2[:-1] - c[:-1] ** 2 / n) + (c2[-1] - c2[:-1] - (c[-1] - c[:-1]) ** 2 / (len(ys) - n))
            cost[xs[1:] == xs[:-1]] = INF
            i = int(np.argmin(cost))
            if cost[i] < INF and (best is None or cost[i] < best[0]):
                best = (cost[i], j, (xs[i] + xs[i + 1]) / 2)
        if best is None:
            return y
        left = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> QuantileForest:
        rng = np.random.default_rng(self.seed)
        self.roots = [self._grow(x[i], y[i], self.depth) for i in (rng.integers(0, len(y), len(y)) for _ in range(self.trees))]
        return self

    def quantiles(self, row: np.ndarray, levels: np.ndarray) -> np.ndarray:
        pool = []
        for node in self.roots:
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            pool.append(node)
        return np.quantile(np.concatenate(pool), levels)


def spci(cal: np.ndarray, test: np.ndarray, alpha: float, w: int = 100, bins: int = 5, trees: int = 10, depth: int = 2, retrain: int = 1, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper quantiles of signed residuals. Up to w of history: linear percentiles (0 without any). Beyond: a
    quantile forest on windows of w residuals, and of `bins` shifts of the level the one of least width. Both hold until
    `retrain` more residuals are known."""
    history = cal[np.isfinite(cal)].tolist()
    shifts = np.linspace(1e-5, max(1e-5, alpha - 1e-5), bins)
    levels = np.clip(np.concatenate([shifts, 1 - alpha + shifts]), 1e-5, 1 - 1e-5)

    def bounds() -> tuple[float, float]:
        h = np.array(history)
        if not len(h):
            return 0.0, 0.0
        if len(h) <= w:
            return tuple(np.percentile(h, [100 * alpha / 2, 100 * (1 - alpha / 2)]))
        forest = QuantileForest(trees, depth, seed).fit(np.lib.stride_tricks.sliding_window_view(h, w)[:-1], h[w:])
        q = forest.quantiles(h[-w:], levels)
        best = int(np.argmin(q[bins:] - q[:bins]))
        return q[best], q[bins + best]

    lo, up, now, age = np.empty(len(test)), np.empty(len(test)), bounds(), 0
    for t, s in enumerate(test.tolist()):
        lo[t], up[t] = now
        if isfinite(s):
            history.append(s)
            age += 1
            if age >= retrain:
                now, age = bounds(), 0
    return lo, up


def _split(x: np.ndarray, y: np.ndarray, inside: np.ndarray, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (nodes by rows by columns) by their best cuts, as QuantileForest._grow has them: (column, value), the column -1
    where a node stays whole. inside says which rows a node has."""
    n = inside.sum(1)
    order = np.argsort(np.where(inside[:, :, None], x, INF), axis=1, kind="stable")
    xs = np.take_along_axis(x, order, 1)
    ys = np.take_along_axis(np.broadcast_to(np.where(inside, y, 0.0)[:, :, None], x.shape), order, 1)
    c, c2 = np.cumsum(ys, 1), np.cumsum(ys**2, 1)
    k = np.arange(1, x.shape[1])[None, :, None]
    rest = n[:, None, None] - k
    with np.errstate(divide="ignore", invalid="ignore"):
        cost = (c2[:, :-1] - c[:, :-1] ** 2 / k) + (c2[:, -1:] - c2[:, :-1] - (c[:, -1:] - c[:, :-1]) ** 2 / rest)
    cost[(rest <= 0) | (xs[:, 1:] == xs[:, :-1])] = INF
    at = np.argmin(cost, 1)
    best = np.take_along_axis(cost, at[:, None], 1)[:, 0]
    column = np.argmin(best, 1)
    one = np.arange(len(x))
    i = at[one, column]
    value = (xs[one, i, column] + xs[one, i + 1, column]) / 2
    return np.where((n >= least) & (best[one, column] < INF), column, -1), value


def _forest_bounds(histories: np.ndarray, seeds: list[int], levels: np.ndarray, w: int, bins: int, trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of keys with as many residuals each (keys by residuals): QuantileForest's trees of all keys are grown a
    level at a time, along the path of the row that is asked for alone."""
    windows = np.lib.stride_tricks.sliding_window_view(histories, w, axis=1)
    x, y, row = windows[:, :-1], histories[:, w:], windows[:, -1]
    keys, n = y.shape
    drawn = np.stack([np.random.default_rng(seed).integers(0, n, (trees, n)) for seed in seeds])
    of = np.repeat(np.arange(keys), trees)
    drawn = drawn.reshape(keys * trees, n)
    ys, rows = y[of[:, None], drawn], row[of]
    inside = np.ones(ys.shape, bool)
    grows = np.ones(len(ys), bool)
    for _ in range(depth if n >= 4 else 0):
        at = np.flatnonzero(grows & (inside.sum(1) >= 4))
        if not len(at):
            break
        own = x[of[at][:, None], drawn[at]]
        column, value = _split(own, ys[at], inside[at])
        cut = np.flatnonzero(column >= 0)
        grows[:] = False
        grows[at[cut]] = True
        chosen = column[cut]
        left = np.take_along_axis(own[cut], chosen[:, None, None], 2)[:, :, 0] <= value[cut, None]
        goes = rows[at[cut], chosen] <= value[cut]
        inside[at[cut]] &= left == goes[:, None]
    pool = np.sort(np.where(inside, ys, INF).reshape(keys, -1), 1)
    last = inside.reshape(keys, -1).sum(1) - 1
    place = last[:, None] * levels
    low = np.floor(place).astype(int)
    t = place - low
    a = np.take_along_axis(pool, low, 1)
    b = np.take_along_axis(pool, np.minimum(low + 1, last[:, None]), 1)
    q = np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t)
    best = np.argmin(q[:, bins:] - q[:, :bins], 1)
    one = np.arange(keys)
    return q[one, best], q[one, bins + best]


#: Numbers that the trees of a chunk of keys may hold at once.
CHUNK = 4_000_000


def spci_many(cal: list[np.ndarray], test: list[np.ndarray], seeds: list[int], alpha: float, w: int = 100, bins: int = 5, trees: int = 10, depth: int = 2, retrain: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """spci() of many keys: steps are taken together, and forests of keys with as much history are grown together."""
    shifts = np.linspace(1e-5, max(1e-5, alpha - 1e-5), bins)
    levels = np.clip(np.concatenate([shifts, 1 - alpha + shifts]), 1e-5, 1 - 1e-5)
    finite = [t[np.isfinite(t)] for t in test]
    begun = [c[np.isfinite(c)] for c in cal]
    history = [np.concatenate(pair) for pair in zip(begun, finite)]
    # A key's bounds are made with its first n residuals, for each n at which it is trained.
    made: list[dict[int, tuple[float, float]]] = [{} for _ in cal]
    due: dict[int, list[int]] = {}
    for i, (b, f) in enumerate(zip(begun, finite)):
        for k in range(0, len(f) + 1, retrain):
            due.setdefault(len(b) + k, []).append(i)
    for n, who in due.items():
        size = max(1, CHUNK // max(1, n * w * trees)) if n > w else 4_096
        for part in (who[a : a + size] for a in range(0, len(who), size)):
            if not n:
                lo = up = np.zeros(len(part))
            elif n <= w:
                lo, up = np.percentile(np.stack([history[i][:n] for i in part]), [100 * alpha / 2, 100 * (1 - alpha / 2)], axis=1)
            else:
                lo, up = _forest_bounds(np.stack([history[i][:n] for i in part]), [seeds[i] for i in part], levels, w, bins, trees, depth)
            for i, a, b in zip(part, lo.tolist(), up.tolist()):
                made[i][n] = (a, b)
    out = []
    for i, t in enumerate(test):
        known = np.concatenate([[0], np.cumsum(np.isfinite(t))])[: len(t)] // retrain * retrain + len(begun[i])
        pairs = [made[i][n] for n in known.tolist()]
        out.append((np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])))
    return out


def _fitted(x: np.ndarray, y: np.ndarray, new: np.ndarray) -> float:
    """Least squares of y on x with an intercept, at new."""
    coef = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    return float(coef[0] + coef[1:] @ new)


def error_forecast(recent: np.ndarray, shorter: np.ndarray) -> float:
    """The next magnitude of a step's error. recent: its last magnitudes; shorter: as many last signed errors of each
    shorter step, a column each, 0 where there are fewer. Without shorter steps the mean; else the average of an
    autoregression of that order and a regression on the shorter steps' errors, each the mean where rows are too few."""
    n, order = len(recent), shorter.shape[1]
    if not n:
        return 0.0
    mean = float(recent.mean())
    if not order:
        return mean
    auto = direct = mean
    if n - order >= 2:
        lags = np.column_stack([recent[order - j - 1 : n - j - 1] for j in range(order)])
        auto = _fitted(lags, recent[order:], recent[::-1][:order])
    if n >= 3 and n > order + 1:
        direct = _fitted(shorter[-n:], recent, shorter[-1])
    return (auto + direct) / 2


def acmcp(cal: np.ndarray, test: np.ndarray, alpha: float, h: int, ncal: int = 10, lr: float = 0.1, csat: float = 1.0, ki: float | None = None, scorecast: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds (lower, upper) of step h from signed errors of steps 0 to h (arrays of windows by steps).

    Both tails track alpha / 2 from the calibration errors' quantile on, at a rate that follows the range of the last
    ncal magnitudes; an integrator answers the running count of misses; from the ncal-th step on the forecast of the
    error's magnitude is added above and taken off below. The shorter steps' errors are those of calibration.
    """
    known = cal[:, -1][np.isfinite(cal[:, -1])]
    ki = (float(np.abs(known).max()) if len(known) else 1.0) if ki is None else ki
    recent = deque(np.abs(known).tolist(), maxlen=ncal)
    shorter = np.zeros((ncal, h))
    for j in range(h):
        last = cal[:, j][np.isfinite(cal[:, j])][-ncal:]
        shorter[ncal - len(last) :, j] = last
    start = lambda e: float(np.sort(e)[int(np.ceil((len(e) - 1) * (1 - alpha / 2)))]) if len(e) else 0.0
    track = {-1: start(-known), 1: start(known)}
    q, misses, steps = dict(track), {-1: 0, 1: 0}, 0
    lo, up = np.empty(len(test)), np.empty(len(test))
    for t, e in enumerate(test[:, -1].tolist()):
        lo[t], up[t] = max(q[-1], 0.0), max(q[1], 0.0)
        if not isfinite(e):
            continue
        rate = lr * (max(recent) - min(recent)) if len(recent) > 1 else lr
        shift = 0.0
        if scorecast and steps >= ncal:
            shift = error_forecast(np.array(recent), shorter[ncal - len(recent) :])
        for side in (-1, 1):
            missed = side * e > max(q[side], 0.0)
            track[side] += rate * (missed - alpha / 2)
            angle = (misses[side] - steps * alpha / 2) * log(steps) / (csat * steps) if steps > 1 else 0.0
            q[side] = track[side] + (ki * tan(angle) if abs(angle) < pi / 2 else 0.0) + side * shift
            misses[side] += missed
        steps += 1
        recent.append(abs(e))
    return lo, up


def key_seed(*key: object) -> int:
    return zlib.crc32(repr(key).encode())


ONLINE: dict[str, Callable[..., np.ndarray]] = {"AgACI": agaci, "DtACI": dtaci}


#: Keys that a task takes together, unless their rows are more than BLOCK_ROWS.
BLOCK_KEYS, BLOCK_ROWS = 512, 200_000


def whole_keys(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, list[tuple], list[int]]]:
    """Blocks of whole keys of batches sorted by key: rows, names and where each key begins (and the end)."""
    held: list[pa.RecordBatch] = []
    names: list[tuple] = []
    starts: list[int] = []
    rows = 0
    for batch in batches:
        own = list(zip(*[batch.column(i).to_pylist() for i in range(keys)]))
        began = 0
        for i, name in enumerate(own):
            if names and name == names[-1]:
                continue
            if len(names) >= BLOCK_KEYS or names and rows + i - began >= BLOCK_ROWS:
                table = pa.Table.from_batches([*held, batch.slice(began, i - began)])
                yield table, names, [*starts, table.num_rows]
                held, names, starts, rows, began = [], [], [], 0, i
            names.append(name)
            starts.append(rows + i - began)
        if began < len(own):
            held.append(batch.slice(began))
            rows += len(own) - began
    if names:
        table = pa.Table.from_batches(held)
        yield table, names, [*starts, table.num_rows]


def by_key(rows: DataFrame, keys: list[str], s: str, out: list[str], fit: Callable[[list[tuple]], list], carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, w, carried columns and `out` of test rows. fit takes (key, calibration scores, test scores), in order of w, of a
    block of keys, and gives arrays for out of each. Keys come one after the other in sorted Arrow batches: a call, a
    frame and a batch for each of very many short keys would cost more than the kernels."""
    types = dict(rows.dtypes)
    n = len(keys)
    kept = [*range(n + 1), *range(n + 3, n + 3 + len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, names, starts in whole_keys(batches, n):
            split, scores = table.column(n + 1).to_numpy(), table.column(n + 2).cast(pa.float64()).to_numpy()
            is_cal, is_test = split == "cal", split == "test"
            given = [(name, scores[a:b][is_cal[a:b]], scores[a:b][is_test[a:b]]) for name, a, b in zip(names, starts, starts[1:])]
            made = fit(given)
            if not is_test.any():
                continue
            taken = table.select(kept).filter(pa.array(is_test))
            for j, name in enumerate(out):
                taken = taken.append_column(name, pa.array(np.concatenate([m[j] for m in made]), pa.float64()))
            yield from taken.combine_chunks().to_batches()

    lean = rows.select(*keys, "w", "split", F.col(s).alias("__s"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)])
    shape = ", ".join([f"`{k}` {types[k]}" for k in [*keys, "w"]] + [f"__c{i} {types[c]}" for i, c in enumerate(carry)] + [f"`{o}` double" for o in out])
    made = lean.repartition(*keys).sortWithinPartitions(*keys, "w").mapInArrow(run, shape)
    return made.select(*keys, "w", *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], *out)


def online(rows: DataFrame, keys: list[str], alpha: float, methods: tuple[str, ...] = ("AgACI", "DtACI"), s: str = "s", size: int = 100, options: dict[str, dict] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, w, carried columns, method, thr of test rows; all methods in one pass over each sorted key."""
    options = options or {}

    def fit(key: tuple, cal: np.ndarray, test: np.ndarray) -> list[np.ndarray]:
        seed = {"seed": key_seed(*map(str, key))}
        return [ONLINE[m](cal, test, alpha, size=size, **(seed if m == "DtACI" else {}), **options.get(m, {})) for m in methods]

    many = by_key(rows, keys, s, [f"__{m}" for m in methods], lambda given: [fit(*g) for g in given], carry)
    told = F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"__{m}").alias("thr")) for m in methods]))
    return many.select(*keys, "w", *carry, told)


def spci_bounds(rows: DataFrame, keys: list[str], alpha: float, e: str = "e", carry: tuple[str, ...] = (), **options) -> DataFrame:
    """keys, w, carried columns, q_lo, q_up: quantiles of the signed residual e, to be added to the forecast."""

    def fit(given: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
        seeds = [key_seed(*map(str, key)) for key, _, _ in given]
        return spci_many([cal for _, cal, _ in given], [test for _, _, test in given], seeds, alpha, **options)

    return by_key(rows, keys, e, ["q_lo", "q_up"], fit, carry)


def acmcp_bounds(rows: DataFrame, keys: list[str], alpha: float, e: str = "e", carry: tuple[str, ...] = (), **options) -> DataFrame:
    """keys, w, h, carried columns, q_lo, q_up; a series' steps are needed together, so the group is the series."""
    types = dict(rows.dtypes)
    n = len(keys)
    kept = [*range(n + 2), *range(n + 4, n + 4 + len(carry))]

    def bounds(w: np.ndarray, h: np.ndarray, is_cal: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows of windows without calibration rows, and which these are."""
        all_w, row = np.unique(w, return_inverse=True)
        all_h, column = np.unique(h, return_inverse=True)
        wide = np.full((len(all_w), len(all_h)), np.nan)
        wide[row, column] = errors
        cal = np.zeros(len(all_w), bool)
        cal[row[is_cal]] = True
        made = np.full((2, *wide.shape), np.nan)
        for k in range(len(all_h)):
            made[0, ~cal, k], made[1, ~cal, k] = acmcp(wide[cal, : k + 1], wide[~cal, : k + 1], alpha, k, **options)
        asked = ~cal[row]
        return made[0, row, column][asked], made[1, row, column][asked], asked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _, starts in whole_keys(batches, n):
            w, h = (table.column(n + i).to_numpy() for i in (0, 1))
            is_cal = table.column(n + 2).to_numpy() == "cal"
            errors = table.column(n + 3).cast(pa.float64()).to_numpy()
            made = [bounds(w[a:b], h[a:b], is_cal[a:b], errors[a:b]) for a, b in zip(starts, starts[1:])]
            lo, up, asked = (np.concatenate(x) for x in zip(*made))
            if not asked.any():
                continue
            taken = table.select(kept).filter(pa.array(asked))
            for name, x in (("q_lo", lo), ("q_up", up)):
                taken = taken.append_column(name, pa.array(x, pa.float64()))
            yield from taken.combine_chunks().to_batches()

    lean = rows.select(*keys, "w", "h", "split", F.col(e).alias("__e"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)])
    shape = ", ".join([f"`{k}` {types[k]}" for k in [*keys, "w", "h"]] + [f"__c{i} {types[c]}" for i, c in enumerate(carry)] + ["q_lo double, q_up double"])
    made = lean.repartition(*keys).sortWithinPartitions(*keys, "w", "h").mapInArrow(run, shape)
    return made.select(*keys, "w", "h", *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], "q_lo", "q_up")
