"""Evaluations that are kept: intervals and metrics of a method, under a digest of all they depend on.

A key is a digest of the panel's snapshot (its files' names, lengths and times), the rows that were asked for, the keys, and
what of the configuration reaches the method. A run computes the methods that have no entry, all of them in one plan, and
reads the others; an entry of an older snapshot has another key and is never read.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.operators import metrics as mt
from calibrant.plans import evaluate as ev
from calibrant.sources.shared import shared_path
from calibrant.sources.store import read_panel


def snapshot(spark: SparkSession, path: str) -> str:
    """A digest of the files under path. Their contents aren't read, and their list stays on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    mark = F.xxhash64("path", "length", F.col("modificationTime").cast("double")).cast("decimal(38,0)")
    got = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(mark), F.lit(0)).alias("marks")).first()
    return hashlib.sha256(f"{got['n']}:{got['bytes']}:{got['marks']}".encode()).hexdigest()


def digest(**parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=repr).encode()).hexdigest()[:32]


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


@dataclass(frozen=True)
class Results:
    """A folder of results: <kind>/<key>, complete once it has _SUCCESS."""

    spark: SparkSession
    root: str

    def path(self, kind: str, key: str) -> str:
        return f"{self.root.rstrip('/')}/{kind}/{key}"

    def has(self, kind: str, key: str) -> bool:
        fs, p = _files(self.spark, f"{self.path(kind, key)}/_SUCCESS")
        return fs.exists(p)

    def read(self, kind: str, key: str) -> DataFrame:
        return self.spark.read.parquet(self.path(kind, key))

    def keep(self, kind: str, rows: DataFrame, keys: dict[str, str]) -> None:
        """Store rows by method, each method under its key: one job writes them all, and folders are renamed when they are
        whole. A method without rows gets an empty table. Two runs that keep the same entry write the same rows."""
        staged = shared_path(self.spark, "results")
        rows.write.partitionBy("method").parquet(staged)
        lean = rows.drop("method")
        for name, key in keys.items():
            fs, target = _files(self.spark, self.path(kind, key))
            made = _files(self.spark, f"{staged}/method={name}")[1]
            fs.mkdirs(target.getParent())
            fs.delete(target, True)
            if not fs.exists(made):
                self.spark.createDataFrame([], lean.schema).write.parquet(self.path(kind, key))
            elif not fs.rename(made, target):
                raise OSError(f"could not move results of {name} to {target}")
            else:
                fs.create(_files(self.spark, f"{self.path(kind, key)}/_SUCCESS")[1], True).close()
        fs.delete(_files(self.spark, staged)[1], True)


def entry_keys(config: ev.EvalConfig, shot: str, where: str | None, keys: tuple[str, ...]) -> dict[str, str]:
    """Each method's key, Native's too. What doesn't reach a method isn't in its key: a static method's doesn't change with
    the window, and Native's with neither the score nor the methods beside it."""
    base = {"snapshot": shot, "where": where, "keys": keys, "alpha": config.alpha, "cal": (config.cal_windows, config.min_cal_windows)}
    found = {"Native": digest(**base, method="Native")}
    for name in ev.classify(config.methods)[0]:
        sized = name in ev.KERNELS or ev.MARGINAL[name].sized
        found[name] = digest(**base, method=name, score=config.score, asymmetric=config.asymmetric, options=config.options.get(name, {}), window=config.window if sized else None)
    return found


def run_cached(spark: SparkSession, predictions: str, config: ev.EvalConfig, root: str, keys: tuple[str, ...] = ("task", "model", "series"), where: str | None = None, force: bool = False) -> DataFrame:
    """run() of a stored panel (of its rows for which `where` holds), with `computed`: whether the method was computed by this
    call. Metrics that root has are read; else intervals that it has are read and their metrics kept; else both are
    made. force makes all again."""
    store, shot = Results(spark, root), snapshot(spark, predictions)
    entries = entry_keys(config, shot, where, keys)
    no_metrics = {n: k for n, k in entries.items() if force or not store.has("metrics", k)}
    missing = {n: k for n, k in no_metrics.items() if force or not store.has("intervals", k)}
    if missing:
        panel = read_panel(spark, predictions)
        wanted = replace(config, methods=tuple(n for n in config.methods if n in missing))
        rows = ev.by_part(panel if where is None else panel.where(where), wanted, keys, lambda part, own, names: ev.every_interval(part, own, names, "Native" in missing))
        store.keep("intervals", rows, missing)
    if no_metrics:
        groups = [k for k in keys if k != "series"]
        each = [store.read("intervals", k).withColumn("method", F.lit(n)) for n, k in no_metrics.items()]
        every = each[0]
        for e in each[1:]:
            every = every.unionByName(e)
        store.keep("metrics", mt.summary(mt.marks(every, config.alpha), [*groups, "method"]), no_metrics)
    parts = [store.read("metrics", k).withColumns({"method": F.lit(n), "computed": F.lit(n in missing)}) for n, k in entries.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return mt.scaled(every, [k for k in keys if k != "series"])
