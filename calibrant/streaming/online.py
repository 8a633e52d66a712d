"""Online calibration as Structured Streaming state: the recurrence of operators.calibrate.aci and trailing, one
state per key, kept in buckets of keys. Rows of a micro-batch are sorted by step before the state takes them; a row that
isn't later than the last one taken is late and gets no output. Memory a key: the last `size` scores and two numbers.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Iterator
from math import isfinite

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from calibrant.operators.kernels import Trailing

STATE = "keys binary"


def _types(keys: list[str], rows: DataFrame) -> str:
    types = dict(rows.dtypes)
    return ", ".join(f"{k} {types[k]}" for k in keys)


def online_aci(rows: DataFrame, keys: list[str], alpha: float, gamma: float = 0.005, size: int = 100, test_from: int = 0, order: str = "w", s: str = "s", buckets: int = 512) -> DataFrame:
    """A streaming frame of keys, w, s, thr, alpha_t for a streaming frame of scores.

    Steps before test_from fill the buffer only. With gamma 0 this is the trailing quantile with correction. Keys share
    one value of state by bucket, for a call and a value for each of very many keys cost more than their steps; a
    checkpoint goes on with the buckets that it began with.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple] = pickle.loads(state.get[0]) if state.exists else {}
        given = [pdf for pdf in parts]
        names = [n for pdf in given for n in zip(*[pdf[k].tolist() for k in keys])]
        steps = [t for pdf in given for t in pdf["__t"].tolist()]
        scores = [x for pdf in given for x in pdf["__s"].tolist()]
        by_name: dict[tuple, list[int]] = {}
        for i, name in enumerate(names):
            by_name.setdefault(tuple(None if x != x else x for x in name), []).append(i)
        made = []
        for name, at in by_name.items():
            a, last, buf = held.get(name, (alpha, -(1 << 62), ()))
            seen = Trailing(np.array(buf, float), size)
            for i in sorted(at, key=steps.__getitem__):
                t, x = steps[i], scores[i]
                if t <= last:
                    continue
                last = t
                x = float(x) if x is not None and isfinite(x) else None
                if t >= test_from:
                    q = seen.quantile(a)
                    made.append((*name, t, x, q, a))
                    if x is not None:
                        a = min(max(a + gamma * (alpha - float(x > q)), 0.0), 1.0)
                if x is not None:
                    seen.add(x)
            held[name] = (a, int(last), array("d", seen.time))
        state.update((pickle.dumps(held),))
        if made:
            yield pd.DataFrame(made, columns=[*keys, "w", "s", "thr", "alpha_t"])

    out = f"{_types(keys, rows)}, w bigint, s double, thr double, alpha_t double"
    dealt = rows.select(*keys, F.col(order).alias("__t"), F.col(s).cast("double").alias("__s"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("__bucket"))
    return dealt.groupBy("__bucket").applyInPandasWithState(update, out, STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(rows: DataFrame, to: str, checkpoint: str) -> DataFrame:
    """Run the stream over what there is, write it to a Parquet table (exactly once) and read that back."""
    query = rows.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(to)
