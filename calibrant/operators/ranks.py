"""Order statistics of unbounded pasts: each row's quantile of all scores of its key before it.

A key's scores are dealt into buckets by value and its steps into blocks by time. Counts by block and bucket, summed over
earlier blocks, say for each step which bucket holds the wanted rank; within a bucket, scores and questions in order of
time are answered from a sorted list. A row passes through both shuffles once, no row carries its past, and a task holds
one block's counts or one bucket's scores.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibrant.functions.stats import INF, conformal_rank, finite
from calibrant.operators.segments import same, with_place
from calibrant.sources.shared import stored

#: Buckets of a key's values, and steps of a block.
BUCKETS, BLOCK = 64, 4_096


class Ordered:
    """A sorted list in runs of a few thousand values: adding and looking up a place cost the square root of its length."""

    LOAD = 2_000

    def __init__(self):
        self.runs: list[list[float]] = []
        self.tops: list[float] = []

    def add(self, v: float) -> None:
        if not self.runs:
            self.runs, self.tops = [[v]], [v]
            return
        k = min(bisect_right(self.tops, v), len(self.runs) - 1)
        insort(run := self.runs[k], v)
        if len(run) > 2 * self.LOAD:
            self.runs[k : k + 1] = [run[: self.LOAD], run[self.LOAD :]]
            self.tops[k : k + 1] = [run[self.LOAD - 1], run[-1]]
        else:
            self.tops[k] = run[-1]

    def place(self, k: int) -> float:
        """The k-th smallest value, from 1."""
        for run in self.runs:
            if k <= len(run):
                return run[k - 1]
            k -= len(run)
        raise IndexError(k)


def _routed(keys: int):
    """Rows sorted by key, block, __mark and order: keys, block, __mark, b, k, counts, then columns to hand on. Of a question
    (k set) the bucket that holds its rank, and its rank in there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, None
        for batch in batches:
            names = list(zip(*[batch.column(i).to_pylist() for i in range(keys + 1)]))
            marks, buckets, ranks, before = (batch.column(keys + 1 + i) for i in range(4))
            marks, buckets, ranks = marks.to_pylist(), buckets.to_pylist(), ranks.to_pylist()
            own, rest, rows = [], [], []
            for i in range(batch.num_rows):
                if names[i] != at:
                    at, counts = names[i], np.zeros(BUCKETS + 1, dtype=np.int64)
                if marks[i] == 0:
                    counts = np.asarray(before[i].as_py(), dtype=np.int64)
                    continue
                if ranks[i] is not None:
                    upto = np.cumsum(counts)
                    j = int(np.searchsorted(upto, ranks[i]))
                    rows.append(i)
                    own.append(j)
                    rest.append(int(ranks[i] - (upto[j - 1] if j else 0)))
                if buckets[i] is not None:
                    counts[buckets[i]] += 1
            if rows:
                taken = batch.take(pa.array(rows, pa.int64()))
                columns = [taken.column(i) for i in (*range(keys), *range(keys + 5, batch.num_columns))]
                names_out = [batch.schema.names[i] for i in (*range(keys), *range(keys + 5, batch.num_columns))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.int32()), pa.array(rest, pa.int64())], names=[*names_out, "b", "k"])

    return run


def _answered(keys: int):
    """Rows sorted by key, bucket and order: keys, b, s, k, then columns to hand on; a question comes before the score of its
    own step. Gives keys, these columns and thr."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, Ordered()
        for batch in batches:
            names = list(zip(*[batch.column(i).to_pylist() for i in range(keys + 1)]))
            scores, ranks = batch.column(keys + 1).to_pylist(), batch.column(keys + 2).to_pylist()
            rows, made = [], []
            for i in range(batch.num_rows):
                if names[i] != at:
                    at, seen = names[i], Ordered()
                if ranks[i] is not None:
                    rows.append(i)
                    made.append(seen.place(ranks[i]))
                else:
                    seen.add(scores[i])
            if rows:
                taken = batch.take(pa.array(rows, pa.int64()))
                kept = [*range(keys), *range(keys + 3, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*[taken.column(i) for i in kept], pa.array(made, pa.float64())], names=[*[batch.schema.names[i] for i in kept], "thr"])

    return run


def past_quantiles(rows: DataFrame, keys: list[str], alpha: float, s: str = "s", order: str = "w", correction: bool = True, carry: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """keys, order, carried columns, s and thr of the test rows: thr is the conformal quantile of the key's scores at all
    earlier steps, infinite where there is none. Scores that are null or not finite don't count. Orders don't repeat in
    a key. A bucket of a key holds about a 64th of its scores, or all those of one value."""
    columns = list(dict.fromkeys([order, *carry]))
    types = dict(rows.dtypes)
    lean = rows.select(*keys, "split", finite(s).cast("double").alias("s"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)])
    lean = stored(lean, "scores")
    placed = with_place(lean, keys, ["__c0"], "n", F.col("s").isNotNull())
    placed = placed.withColumn("block", F.floor(F.col("n") / block).cast("bigint"))
    own = [f"__k{i}" for i in range(len(keys))]
    cuts = lean.where("s IS NOT NULL").groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own)]).agg(F.percentile_approx("s", [k / BUCKETS for k in range(1, BUCKETS)], 10_000).alias("cuts"))
    # Values up to a cut belong to its bucket, so equal values share one.
    bucket = F.when(F.col("s").isNotNull(), F.size(F.filter("cuts", lambda c: c < F.col("s"))))
    rank = F.when((F.col("split") == "test") & (F.col("n") > 0), F.least(F.greatest(conformal_rank(F.col("n"), alpha, correction).cast("bigint"), F.lit(1)), F.col("n")))
    every = stored(placed.join(cuts, same(keys, own), "left").withColumn("b", bucket).withColumn("k", rank).drop("cuts", *own), "ranked")
    counts = every.where("b IS NOT NULL").groupBy(*keys, "block", "b").agg(F.count("*").alias("c"))
    blocks = every.select(*keys, "block").distinct()
    # For each block the counts of all earlier ones: as many rows as blocks.
    by_block = counts.groupBy(*keys, "block").agg(F.map_from_entries(F.collect_list(F.struct("b", "c"))).alias("m"))
    filled = blocks.withColumnRenamed("block", "__block").alias("x").join(by_block.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], "block", "m"), same(keys, own) & (F.col("__block") == F.col("block")), "left")
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = F.array(*[F.coalesce(F.sum(F.coalesce(F.try_element_at("m", F.lit(i)), F.lit(0))).over(earlier), F.lit(0)) for i in range(BUCKETS + 1)])
    before = filled.select(*keys, F.col("__block").alias("block"), sums.alias("counts"))
    handed = [f"__c{i}" for i in range(len(columns))]
    steps = every.select(*keys, "block", F.lit(1).alias("__mark"), "b", "k", F.lit(None).cast("array<bigint>").alias("counts"), F.col("s").alias("__s"), *handed)
    stream = steps.unionByName(before.withColumn("__mark", F.lit(0)), allowMissingColumns=True).repartition(*keys, "block").sortWithinPartitions(*keys, "block", "__mark", "__c0")
    shape = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "__s double", *[f"`{h}` {types[c]}" for h, c in zip(handed, columns)]])
    asked = stream.mapInArrow(_routed(len(keys)), f"{shape}, b int, k bigint")
    given = every.where("b IS NOT NULL").select(*keys, "b", "s", F.lit(None).cast("bigint").alias("k"), F.lit(None).cast("double").alias("__s"), *handed)
    both = asked.select(*keys, "b", F.lit(None).cast("double").alias("s"), "k", "__s", *handed).union(given)
    sorted_ = both.repartition(*keys, "b").sortWithinPartitions(*keys, "b", "__c0", F.col("k").isNull())
    found = sorted_.mapInArrow(_answered(len(keys)), f"{shape}, thr double")
    none = every.where("split = 'test' AND k IS NULL").select(*keys, F.col("s").alias("__s"), *handed, F.lit(INF).alias("thr"))
    return found.union(none).select(*keys, *[F.col(h).alias(c) for h, c in zip(handed, columns)], F.col("__s").alias("s"), "thr")
