"""Prediction stores and result files."""

from __future__ import annotations

import hashlib
import io
import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrant.functions.scores import slug
from calibrant.functions.stats import FIELDS, LEVELS

PANEL = ("task string, model string, series string, w int, h int, y double, yhat double, q struct<" + ", ".join(f"{f}: double" for f in FIELDS) + ">, split string")
NPZ = pa.schema([("file", pa.string()), ("name", pa.string()), ("w", pa.int32()), ("i", pa.int32()), ("values", pa.list_(pa.float64()))])
RESERVED = ("predictions", "target", "item_id", "id", "timestamp", "start", "freq", "series", "w")


def write_panel(panel: DataFrame, path: str) -> None:
    """Parquet by model and task, so that readers of one skip the others."""
    panel.write.partitionBy("model", "task").mode("overwrite").parquet(path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """Only the quantiles that a query uses are read: q is a struct."""
    return spark.read.schema(PANEL).parquet(path)


def level_columns(df: DataFrame) -> dict[str, float]:
    """Columns whose names are levels within (0, 1), in order of level."""
    found = {}
    for c in df.columns:
        if c not in RESERVED:
            try:
                v = float(c)
            except ValueError:
                continue
            if 0 < v < 1:
                found[c] = v
    return dict(sorted(found.items(), key=lambda x: x[1]))


def import_windows(predictions: DataFrame, truth: DataFrame, task: str, model: str, cal_windows: int, id_column: str = "item_id") -> DataFrame:
    """A panel from rows of a window and series with arrays by step: predictions and a column per level; truth has
    the array target. Levels that the grid lacks are left out, missing ones are null."""
    levels = level_columns(predictions)
    names = {f: next((c for c, v in levels.items() if abs(v - t) < 1e-6), None) for f, t in zip(FIELDS, LEVELS)}
    both = predictions.select(F.col(id_column).cast("string").alias("series"), "w", F.posexplode("predictions").alias("h", "yhat"), *[F.col(f"`{c}`").alias(f"__{f}") for f, c in names.items() if c])
    grid = F.struct(*[(F.get(f"__{f}", F.col("h")).cast("double") if c else F.lit(None).cast("double")).alias(f) for f, c in names.items()])
    pred = both.select("series", "w", "h", F.col("yhat").cast("double").alias("yhat"), grid.alias("q"))
    true = truth.select(F.col(id_column).cast("string").alias("series"), "w", F.posexplode("target").alias("h", "y")).withColumn("y", F.col("y").cast("double"))
    rows = pred.join(true, ["series", "w", "h"])
    return rows.select(F.lit(task).alias("task"), F.lit(model).alias("model"), "series", "w", "h", "y", "yhat", "q", F.when(F.col("w") < cal_windows, "cal").otherwise("test").alias("split"))


def read_window_dirs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of <path>/window_<w>/<kind> in Parquet, with w by number."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{path}/window_*/{kind}")
    return rows.withColumn("w", F.regexp_extract(F.input_file_name(), r"window_(\d+)", 1).cast("int"))


def npz_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, w, i, values) of the arrays in NumPy archives under path: arrays of windows by items by steps, or of
    items by steps, whose window is the number in the file's folder (else 0). Arrays of objects are refused."""

    def rows(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                found = re.search(r"window_(\d+)", file)
                with np.load(io.BytesIO(content.as_buffer()), allow_pickle=False) as z:
                    for name in z.files:
                        x = np.asarray(z[name], float)
                        x = x.reshape((1,) * (3 - x.ndim) + x.shape) if x.ndim < 3 else x
                        w = range(len(x)) if len(x) > 1 or not found else [int(found[1])]
                        for k, block in zip(w, x):
                            yield pa.RecordBatch.from_pydict({"file": [file] * len(block), "name": [name] * len(block), "w": [k] * len(block), "i": list(range(len(block))), "values": list(block)}, schema=NPZ)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(path)
    return files.select("path", "content").mapInArrow(rows, "file string, name string, w int, i int, values array<double>")


def npz_windows(rows: DataFrame, point: str = "predictions") -> DataFrame:
    """Rows of npz_rows as import_windows takes them: w, item_id, predictions and a column of arrays per level. Names may
    begin with q or quantile_ before the level; names are the archive's, which are few."""
    names = {r[0]: re.sub(r"^(quantile_|q_?)(?=0?\.)", "", r[0]) for r in rows.select("name").distinct().collect()}
    cols = [F.max(F.when(F.col("name") == n, F.col("values"))).alias("predictions" if n == point else c) for n, c in sorted(names.items())]
    return rows.groupBy("w", F.concat(F.lit("series_"), F.col("i").cast("string")).alias("item_id")).agg(*cols)


def unified_windows(rows: DataFrame, order: str = "w") -> DataFrame:
    """Rows of a window with all its series (arrays of series by steps, and item_id) as a row for each window and series."""
    arrays = [c for c, t in rows.dtypes if t.startswith("array<array<")]
    zipped = F.posexplode(F.arrays_zip(*([F.col("item_id")] if "item_id" in rows.columns else []), *[F.col(f"`{c}`").alias(c) for c in arrays]))
    each = rows.select(order, zipped.alias("__i", "z"))
    ident = F.col("z.item_id") if "item_id" in rows.columns else F.concat(F.lit("series_"), F.col("__i").cast("string"))
    return each.select(order, ident.alias("item_id"), *[F.col("z").getField(c).alias(c) for c in arrays])


def cached(spark: SparkSession, root: str, build: Callable[[], DataFrame], force: bool = False, **params) -> DataFrame:
    """build()'s rows, kept under root by a digest of the parameters: a later call with the same ones reads them. force
    builds them again. A write that was cut short is not read."""
    key = hashlib.md5(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()
    path = f"{root.rstrip('/')}/{key}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
    if force or not there:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def discover_windows(panel: DataFrame) -> DataFrame:
    return panel.select("w").distinct().orderBy("w")


def write_metadata(spark: SparkSession, path: str, **values) -> None:
    spark.createDataFrame([values]).coalesce(1).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Task metadata under root, at any depth; tasks with test windows."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root)
    return rows.where("test_windows > 0") if "test_windows" in rows.columns else rows


def read_documents(spark: SparkSession, root: str, fields: dict[str, tuple[tuple[str, ...], str]], pattern: str = "*.json") -> DataFrame:
    """A row for each JSON file under root, at any depth: file and fields, each the first of its paths that has a value of its
    type. Files needn't agree in keys or types, as each is read as a variant: what is missing or can't be cast is null, and so
    is everything of a file that is not JSON. No files give no rows."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("wholetext", "true").text(root)
    parsed = files.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    return parsed.select("file", *[F.coalesce(*[F.try_variant_get("v", p, kind) for p in paths]).alias(name) for name, (paths, kind) in fields.items()])


def result_name(kind: str, alpha: float, score: str, cal_windows: int | None, mode: str, asymmetric: bool = False, online: bool = False) -> str:
    """A result's name holds its parameters; result_parameters reads them back."""
    parts = [kind, f"alpha{alpha:g}", slug(score), f"cal{'all' if cal_windows in (None, -1) else cal_windows}", mode]
    return "_".join(parts + ["asymm"] * asymmetric + ["online"] * online)


def result_parameters(name: str) -> dict:
    m = re.fullmatch(r"(?P<kind>.+)_alpha(?P<alpha>[\d.]+)_(?P<score>[a-z-]+)_cal(?P<cal>all|\d+)_(?P<mode>[a-z-]+?)(?P<asymm>_asymm)?(?P<online>_online)?", name)
    if not m:
        return {}
    return {"kind": m["kind"], "alpha": float(m["alpha"]), "score": m["score"].replace("-", "_"), "cal_windows": -1 if m["cal"] == "all" else int(m["cal"]), "mode": m["mode"], "asymmetric": bool(m["asymm"]), "online": bool(m["online"])}


def write_csv(rows: DataFrame, root: str, name: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(f"{root}/{name}.csv")


#: Names that columns of result files have had, and what they are now.
RENAMED = {"winkler": "winkler_score", "width": "avg_width", "mean_width": "avg_width", "score_type": "score", "cal": "cal_windows"}


def unified(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of schema: by their names or older ones; metrics given as <name>_median and <name>_mean are the median, else
    the mean; what is missing is null."""
    have = {c.lower(): c for c in rows.columns}
    old: dict[str, list[str]] = {}
    for was, now in RENAMED.items():
        old.setdefault(now, []).append(was)
    out = []
    for f in schema:
        names = [f.name, f"{f.name}_median", f"{f.name}_mean", *old.get(f.name, ())]
        found = [F.col(f"`{have[n]}`").cast(f.dataType) for n in names if n in have]
        out.append((F.coalesce(*found) if found else F.lit(None).cast(f.dataType)).alias(f.name))
    return rows.select(*out, *[c for c in ("__file",) if c in rows.columns])


def read_results(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All result CSVs under root, written as folders or single files, with the parameters from their names; files may have
    columns in any order, some of them, and under older names. NaN and infinite metrics become null. No files give no rows."""
    wanted = spark.createDataFrame([], schema).schema
    reader = spark.read.option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(root)
    # A file's first split is read by one task in order; rows of its other splits can't come first.
    first = lines.where("_metadata.file_block_start = 0").select(F.input_file_name().alias("f"), "value").groupBy("f").agg(F.first("value").alias("header"))
    headers = {r[0] for r in first.select("header").distinct().collect()}  # the kinds of files, a few
    parts = []
    for h in sorted(headers):
        files = [r[0] for r in first.where(F.col("header") == h).select("f").collect()]
        parts.append(unified(reader.csv(files).withColumn("__file", F.input_file_name()), wanted))
    rows = parts[0] if parts else spark.createDataFrame([], wanted).withColumn("__file", F.lit(""))
    for x in parts[1:]:
        rows = rows.unionByName(x)
    name = F.regexp_extract("__file", r"([^/]+)\.csv(?:/|$)", 1)
    rows = rows.withColumn("alpha", F.regexp_extract(name, r"_alpha([\d.]+)", 1).cast("double")).withColumn("score", F.regexp_replace(F.regexp_extract(name, r"_alpha[\d.]+_([a-z-]+)_", 1), "-", "_")).drop("__file")
    return rows.select(*[F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def dashboard(models: DataFrame, tasks: DataFrame, meta: DataFrame) -> DataFrame:
    """One JSON document of summaries by model and by task and the tasks' metadata; the frames are report-sized."""
    doc = lambda df, name: df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
    return doc(models, "model_summaries").crossJoin(doc(tasks, "task_summaries")).crossJoin(doc(meta, "tasks_metadata")).select(F.to_json(F.struct("*")).alias("document"))


def html(document: DataFrame, title: str = "Results") -> str:
    """A page that holds dashboard()'s document, for a script or a reader; the document is report-sized."""
    text = document.first()[0].replace("</", "<\\/")
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{title}</title></head><body><script type='application/json' id='data'>{text}</script></body></html>"
