"""Sequential calibrators over keys of any length: a key's steps are cut into segments.

Methods whose threshold is a function of the last scores run on all segments at once, each behind a copy of the scores
before it. Methods that learn pass their state from segment to segment: round r takes the r-th segment of every key, so
short keys are done after the first. A round is one shuffle by key and one sort; a task walks through its sorted rows
in Arrow batches, whatever keys these belong to, and holds the state of one key.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from math import ceil, inf, isfinite, log, pi, tan
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibrant.sources.shared import stored

#: Steps of a key that one task takes at most.
SEGMENT = 100_000
#: Rounds of a method that learns at most: beyond so many segments of a key, these are longer.
ROUNDS = 16


def same(a: list[str], b: list[str]) -> Column:
    """Keys are equal; nulls are equal too."""
    cond = F.col(a[0]).eqNullSafe(F.col(b[0]))
    for x, y in zip(a[1:], b[1:]):
        cond = cond & F.col(x).eqNullSafe(F.col(y))
    return cond


def with_place(rows: DataFrame, keys: list[str], order: list[str], name: str = "place", weight: Column | None = None) -> DataFrame:
    """rows with the weight of the key's rows before each (None: their number).

    The table is sorted into ranges by key and order; a range counts each of its keys from 0 and starts where the key's
    earlier ranges end, so that a long key is counted by many tasks. Rows are stored between the two passes."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = rows.withColumn("__weight", F.lit(1) if weight is None else weight.cast("int"))
    ranged = stored(marked.repartitionByRange(parts, *[F.col(c) for c in (*keys, *order)]).withColumn("__range", F.spark_partition_id()), "placed")
    own = [f"__{c}" for c in keys]
    counts = ranged.groupBy("__range", *keys).agg(F.sum("__weight").alias("c"))
    before = F.sum("c").over(Window.partitionBy(*keys).orderBy("__range")) - F.col("c")
    starts = counts.select(F.col("__range").alias("__of"), *[F.col(k).alias(o) for k, o in zip(keys, own)], before.alias("__before"))
    inside = F.sum("__weight").over(Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(starts, (F.col("__range") == F.col("__of")) & same(keys, own))
    return placed.withColumn(name, F.col("__before") + F.col("__inside")).drop("__weight", "__range", "__of", "__before", "__inside", *own)


def quantile(values: list[float], alpha: float, correction: bool = True) -> float:
    """The conformal quantile of sorted values, as functions.stats has it."""
    n = len(values)
    if not n:
        return inf
    level = min(ceil((n + 1) * (1 - alpha)) / n, 1.0) if correction else 1 - alpha
    return values[ceil(min(max(level, 0.0), 1.0) * (n - 1))]


class Steps(Protocol):
    """A method's walk along a key. learns: whether its state depends on its own thresholds, so that segments wait for
    each other; else lookback says how many scores before a step it needs."""

    learns: bool

    def start(self) -> object: ...

    def test(self, state: object, s: float | None, extra: float | None) -> tuple[float, float | None]:
        """(threshold, alpha_t) of a test step before its score is seen; the state then takes that."""

    def see(self, state: object, s: float) -> None:
        """The score of any step enters the trailing scores."""


class Recent:
    """The last `size` scores, by age and by value."""

    __slots__ = ("by_age", "by_value", "size")

    def __init__(self, size: int):
        self.size, self.by_age, self.by_value = size, deque(), []

    def add(self, s: float) -> None:
        if len(self.by_age) == self.size:
            del self.by_value[bisect_left(self.by_value, self.by_age.popleft())]
        self.by_age.append(s)
        insort(self.by_value, s)


class Trailing:
    learns = False

    def __init__(self, alpha: float, size: int, correction: bool = False):
        self.alpha, self.lookback, self.correction = alpha, size, correction

    def start(self):
        return Recent(self.lookback)

    def test(self, state, s, extra):
        return quantile(state.by_value, self.alpha, self.correction), None

    def see(self, state, s):
        state.add(s)


class Weighted(Trailing):
    """Weights decay ** age, or the given ones, the newest score's last; and test_weight of the unseen point."""

    def __init__(self, alpha: float, size: int, decay: float = 0.99, test_weight: float = 1.0, weights: tuple[float, ...] | None = None):
        super().__init__(alpha, size)
        self.decay, self.test_weight, self.weights = decay, test_weight, weights

    def weight(self, age: int) -> float:
        if self.weights is None:
            return self.decay ** float(age)
        return float(self.weights[-1 - age]) if age < len(self.weights) else 0.0

    def test(self, state, s, extra):
        n = len(state.by_age)
        ordered = [(v, self.weight(n - 1 - k)) for k, v in enumerate(state.by_age)]
        total, c = 0.0, 0.0
        for _, p in ordered:
            total += p
        for v, p in sorted(ordered):
            c += p
            if c >= (1 - self.alpha) * (total + self.test_weight):
                return v, None
        return inf, None


class Adaptive(Trailing):
    """ACI: alpha_t moves by gamma * (alpha - missed)."""

    learns = True

    def __init__(self, alpha: float, size: int, gamma: float = 0.005, correction: bool = True):
        super().__init__(alpha, size, correction)
        self.gamma = gamma

    def start(self):
        return [self.alpha, Recent(self.lookback)]

    def test(self, state, s, extra):
        a = state[0]
        q = quantile(state[1].by_value, a, self.correction)
        if s is not None:
            state[0] = min(max(a + self.gamma * (self.alpha - (1.0 if s > q else 0.0)), 0.0), 1.0)
        return q, a

    def see(self, state, s):
        state[1].add(s)


class Tracking(Trailing):
    """PID: the threshold starts at `extra` (infinite or missing: 0) and follows the misses at a rate that is lr times the
    range of the trailing scores; ki adds the saturated integral of the errors."""

    learns = True

    def __init__(self, alpha: float, size: int, lr: float = 0.1, ki: float = 0.0, c_sat: float = 1.0, proportional: bool = True):
        super().__init__(alpha, size)
        self.lr, self.ki, self.c_sat, self.proportional = lr, ki, c_sat, proportional

    def start(self):
        return {"qt": None, "q": None, "e": 0.0, "n": 0.0, "past": Recent(self.lookback)}

    def test(self, state, s, extra):
        if state["qt"] is None:
            state["qt"] = state["q"] = extra if extra is not None and extra < inf else 0.0
        q = state["q"]
        if s is not None:
            missed, past = (1.0 if s > q else 0.0), state["past"].by_value
            rate = self.lr * (past[-1] - past[0] if past and self.proportional else 1.0)
            integral = 0.0
            if self.ki:
                angle = (state["e"] - state["n"] * self.alpha) * log(state["n"] + 1) / (self.c_sat * (state["n"] + 1))
                integral = self.ki * tan(angle) if abs(angle) < pi / 2 else 0.0
            state["qt"] -= rate * (self.alpha - missed)
            state["q"] = state["qt"] + integral
            state["e"] += missed
            state["n"] += 1
        return q, None

    def see(self, state, s):
        state["past"].add(s)


def _walked(method: Steps, keys: int, carried: int, keep: bool):
    """mapInArrow over rows sorted by key and order: keys, __mark, split, s, __extra, __state, carried columns. __mark is 0
    for a key's state, 1 for scores that are only looked back at, 2 for steps. Gives keys, carried columns, s, thr, alpha_t
    and __state; with keep, each key that had steps ends with a row of its state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, stepped, schema = None, None, False, None

        def ending() -> Iterator[pa.RecordBatch]:
            if keep and stepped:
                row = [pa.array([v], f.type) for v, f in zip(key, schema)]
                row += [pa.nulls(1, f.type) for f in list(schema)[keys:-1]]
                yield pa.RecordBatch.from_arrays([*row, pa.array([pickle.dumps(state)], pa.binary())], schema=schema)

        for batch in batches:
            given = batch.schema
            fields = [*list(given)[:keys], *list(given)[keys + 5 :]]
            schema = pa.schema([*fields, pa.field("s", pa.float64()), pa.field("thr", pa.float64()), pa.field("alpha_t", pa.float64()), pa.field("__state", pa.binary())])
            names = list(zip(*[batch.column(i).to_pylist() for i in range(keys)]))
            marks, splits, scores, extras, states = (batch.column(keys + i).to_pylist() for i in range(5))
            at, s_out, thr, alpha_t = [], [], [], []
            ended: list[pa.RecordBatch] = []
            for i in range(batch.num_rows):
                if names[i] != key:
                    if key is not None:
                        ended += ending()
                    key, state, stepped = names[i], method.start(), False
                if marks[i] == 0:
                    state = pickle.loads(states[i])
                    continue
                s = scores[i]
                s = s if s is not None and isfinite(s) else None
                if marks[i] == 2:
                    stepped = True
                    if splits[i] == "test":
                        q, a = method.test(state, s, extras[i])
                        at.append(i)
                        s_out.append(s)
                        thr.append(q)
                        alpha_t.append(a)
                if s is not None:
                    method.see(state, s)
            yield from ended
            if at:
                taken = batch.take(pa.array(at, pa.int64()))
                columns = [taken.column(i) for i in (*range(keys), *range(keys + 5, keys + 5 + carried))]
                made = [pa.array(x, pa.float64()) for x in (s_out, thr, alpha_t)]
                yield pa.RecordBatch.from_arrays([*columns, *made, pa.nulls(len(at), pa.binary())], schema=schema)
        if key is not None:
            yield from ending()

    return run


def scan(rows: DataFrame, keys: list[str], method: Steps, order: list[str] | str = "w", s: str = "s", extra: str | None = None, carry: tuple[str, ...] = (), segment: int = SEGMENT) -> DataFrame:
    """keys, order, carried columns, s, thr and alpha_t (null but for ACI) of the test rows of `rows`, each of which knows
    the rows of its key before it. extra is a column that a method's start needs. Orders don't repeat in a key."""
    order = [order] if isinstance(order, str) else order
    columns = list(dict.fromkeys([*order, *[c for c in carry if c not in keys]]))
    types = dict(rows.dtypes)
    lean = rows.select(*keys, "split", F.col(s).cast("double").alias("s"), (F.col(extra) if extra else F.lit(None)).cast("double").alias("__extra"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)])
    places = [f"__c{i}" for i in range(len(order))]
    shape = ", ".join([*[f"`{k}` {types[k]}" for k in keys], *[f"`__c{i}` {types[c]}" for i, c in enumerate(columns)], "s double", "thr double", "alpha_t double", "__state binary"])
    lean = stored(lean, "steps")
    longest = lean.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0

    def walked(part: DataFrame, by: list[str], keep: bool) -> DataFrame:
        given = part.select(*by, "__mark", "split", "s", "__extra", "__state", *[f"__c{i}" for i in range(len(columns))])
        dealt = given.repartition(*by).sortWithinPartitions(*by, "__mark", *places)
        return dealt.mapInArrow(_walked(method, len(by), len(columns), keep), ("" if by == keys else "__segment bigint, ") + shape)

    blank = F.lit(None).cast("binary")
    if longest <= segment:
        made = walked(lean.withColumns({"__mark": F.lit(2), "__state": blank}), keys, False)
    elif not method.learns:
        scored = F.col("s").isNotNull() & ~F.isnan("s") & (F.abs("s") < F.lit(inf))
        placed = with_place(lean, keys, places, "__place", scored).withColumn("__segment", F.floor(F.col("__place") / segment).cast("bigint"))
        # Of a segment's last scores copies go before the following segments, as far as these look back.
        reach = F.floor((F.col("__place") + method.lookback) / segment).cast("bigint")
        copies = placed.where(scored & (reach > F.col("__segment"))).withColumn("__segment", F.explode(F.sequence(F.col("__segment") + 1, reach))).withColumn("__mark", F.lit(1))
        both = placed.withColumn("__mark", F.lit(2)).unionByName(copies).withColumn("__state", blank)
        made = walked(both, ["__segment", *keys], False).drop("__segment")
    else:
        # Rounds follow each other, so there are only so many: keys that are longer have longer segments. A task takes its
        # rows in Arrow batches of a sort that spills, and holds the state of one key.
        segment = max(segment, -(-longest // ROUNDS))
        placed = stored(with_place(lean, keys, places, "__place"), "segments")
        parts, state = [], None
        for r in range(-(-longest // segment)):
            part = placed.where((F.col("__place") >= r * segment) & (F.col("__place") < (r + 1) * segment)).drop("__place").withColumns({"__mark": F.lit(2), "__state": blank})
            part = part if state is None else part.unionByName(state, allowMissingColumns=True)
            done = stored(walked(part, keys, True), "segment")
            parts.append(done.where("__state IS NULL"))
            state = done.where("__state IS NOT NULL").select(*keys, "__state", F.lit(0).alias("__mark"))
        made = parts[0]
        for p in parts[1:]:
            made = made.union(p)
    return made.select(*keys, *[F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)], "s", "thr", "alpha_t")


def aci(rows: DataFrame, keys: list[str], alpha: float, gamma: float = 0.005, size: int = 100, s: str = "s", order: str = "w", carry: tuple[str, ...] = (), correction: bool = True, segment: int = SEGMENT) -> DataFrame:
    """calibrate.aci for keys of any length."""
    return scan(rows, keys, Adaptive(alpha, size, gamma, correction), order, s, carry=carry, segment=segment)


def pid(rows: DataFrame, keys: list[str], alpha: float, lr: float = 0.1, ki: float = 0.0, c_sat: float = 1.0, size: int = 100, proportional: bool = True, s: str = "s", order: str = "w", carry: tuple[str, ...] = (), q0: str = "q0", segment: int = SEGMENT) -> DataFrame:
    """calibrate.pid for keys of any length; the column q0 is what thresholds start at."""
    return scan(rows, keys, Tracking(alpha, size, lr, ki, c_sat, proportional), order, s, q0, carry, segment).drop("alpha_t")


def trailing(rows: DataFrame, keys: list[str], alpha: float, size: int = 100, s: str = "s", order: str = "w", carry: tuple[str, ...] = (), correction: bool = False, segment: int = SEGMENT) -> DataFrame:
    """calibrate.trailing for keys of any length."""
    return scan(rows, keys, Trailing(alpha, size, correction), order, s, carry=carry, segment=segment).drop("alpha_t")


def weighted(rows: DataFrame, keys: list[str], alpha: float, size: int = 100, decay: float = 0.99, test_weight: float = 1.0, s: str = "s", order: str = "w", carry: tuple[str, ...] = (), segment: int = SEGMENT) -> DataFrame:
    """calibrate.weighted for keys of any length."""
    return scan(rows, keys, Weighted(alpha, size, decay, test_weight), order, s, carry=carry, segment=segment).drop("alpha_t")
