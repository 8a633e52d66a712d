"""Raw series datasets: formats, conversion to long rows, splits and statistics."""

from __future__ import annotations

import json
import warnings
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

# Calendar steps of frequency aliases, their seasonal periods, and default horizons of short terms.
STEPS = {"A": "1 year", "Y": "1 year", "Q": "3 months", "M": "1 month", "W": "7 days", "D": "1 day", "B": "1 day", "H": "1 hour", "T": "1 minute", "MIN": "1 minute", "S": "1 second", "U": "1 microsecond"}
SEASONS = {"A": 1, "Y": 1, "Q": 4, "M": 12, "W": 1, "D": 7, "B": 5, "H": 24, "T": 1440, "MIN": 1440, "S": 3600, "U": 1}
HORIZONS = {"A": 6, "Y": 6, "Q": 8, "M": 12, "W": 8, "D": 30, "B": 30, "H": 48, "T": 48, "MIN": 48, "S": 60, "U": 60}
TERMS = {"short": 1, "medium": 10, "long": 15}
MAX_WINDOWS, TEST_SHARE = 20, 0.1


def alias(freq: str) -> tuple[int, str]:
    """(multiple, unit) of a frequency alias such as 15T, W-SUN, QS or MS."""
    f = freq.upper().split("-")[0]
    digits = "".join(c for c in f if c.isdigit())
    unit = f[len(digits) :]
    for u in (unit, unit.removesuffix("S"), unit.removesuffix("E"), unit[:1]):
        if u in STEPS:
            return int(digits or 1), u
    raise ValueError(f"unknown frequency: {freq}")


def step(freq: str) -> Column:
    n, unit = alias(freq)
    k, name = STEPS[unit].split(" ")
    return F.expr(f"interval {int(k) * n} {name}")


def seasonality(freq: str) -> int:
    n, unit = alias(freq)
    return max(1, SEASONS[unit] // n)


def horizon(freq: str, term: str = "short") -> int:
    return HORIZONS[alias(freq)[1]] * TERMS[term]


def is_gift_eval(df: DataFrame) -> bool:
    return {"item_id", "start", "freq", "target"} <= {*df.columns}


def is_fev(df: DataFrame) -> bool:
    return {"id", "timestamp"} <= {*df.columns} and "start" not in df.columns


def is_multivariate(df: DataFrame, field: str = "target") -> bool:
    kind = df.schema[field].dataType
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)


def load(spark: SparkSession, root: str, name: str, subset: str | None = None, freq: str | None = None) -> DataFrame | None:
    """<root>/<name>/<subset>/<freq>, leaving out parts that aren't given; None where there is nothing to read."""
    path = "/".join(p for p in (root.rstrip("/"), name, subset, freq) if p)
    try:
        return spark.read.option("recursiveFileLookup", "true").parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def converted(spark: SparkSession, source: DataFrame, freq: str, cache: str, **options) -> DataFrame:
    """to_fev(source), written once: a later call reads the cache."""
    there = load(spark, cache, "")
    if there is None:
        to_fev(source, freq, **options).write.mode("ignore").parquet(cache)
        there = spark.read.parquet(cache)
    return there


def transpose(x: Column) -> Column:
    """[dims][steps] to [steps][dims]."""
    return F.transform(F.sequence(F.lit(0), F.size(F.get(x, 0)) - 1), lambda i: F.transform(x, lambda d: F.get(d, i)))


def to_fev(df: DataFrame, freq: str, id_column: str = "id", timestamp_column: str = "timestamp", variates: list[str] | None = None, keep_extra: bool = True) -> DataFrame:
    """A row per series with an array of timestamps: start and freq become timestamps, a multivariate target one
    column per variate, nested covariates are transposed. A FEV frame stays as it is."""
    if is_fev(df):
        return df
    if missing := {"item_id", "start", "target"} - {*df.columns}:
        raise ValueError(f"missing columns: {sorted(missing)}")
    nested = is_multivariate(df)
    n = F.size(F.get("target", 0)) if nested else F.size("target")
    times = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("start") + i * step(freq))
    times = F.when(n > 0, times).otherwise(F.array().cast("array<timestamp>"))
    cols = [F.col("item_id").alias(id_column), times.alias(timestamp_column)]
    if nested:
        if not variates:
            dims = df.agg(F.max(F.size("target"))).first()[0] or 0
            variates = [f"target_{k}" for k in range(dims)]
        cols += [F.get("target", k).alias(v) for k, v in enumerate(variates)]
    else:
        cols.append(F.col("target"))
    if keep_extra:
        for c in df.columns:
            if c not in ("item_id", "start", "freq", "target", "variate_names"):
                kind = df.schema[c].dataType
                is_nested = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)
                cols.append((transpose(F.col(c)) if is_nested else F.col(c)).alias(c))
    return df.select(*cols)


def to_long(fev: DataFrame, targets: list[str] | None = None, id_column: str = "id", timestamp_column: str = "timestamp") -> DataFrame:
    """(series, t from 1, ts, one column per target): parallel arrays zipped and exploded."""
    targets = targets or ["target"]
    rows = fev.select(F.col(id_column).alias("series"), F.posexplode(F.arrays_zip(F.col(timestamp_column).alias("ts"), *[F.col(c).alias(c) for c in targets])).alias("t", "z"))
    return rows.select("series", (F.col("t") + 1).alias("t"), "z.ts", *[F.col(f"z.{c}").alias(c) for c in targets])


def univariate(df: DataFrame, field: str = "target", id_column: str = "item_id") -> DataFrame:
    """One row per dimension, with _dim<k> after its id; univariate frames stay."""
    if not is_multivariate(df, field):
        return df
    rest = [c for c in df.columns if c not in (field, id_column)]
    return df.select(id_column, *rest, F.posexplode(field).alias("__k", field)).withColumn(id_column, F.concat(id_column, F.lit("_dim"), F.col("__k").cast("string"))).drop("__k")


def window_count(min_length: Column | int, prediction: int, m4: bool = False) -> Column:
    """min(max(1, ceil(a tenth of the shortest series / prediction)), 20); 1 for M4 datasets."""
    n = min_length if isinstance(min_length, Column) else F.lit(min_length)
    return F.lit(1) if m4 else F.least(F.greatest(F.lit(1), F.ceil(n * TEST_SHARE / prediction).cast("int")), F.lit(MAX_WINDOWS))


def statistics(df: DataFrame, prediction: int, field: str = "target") -> DataFrame:
    """One row: series, dims, min_length, sum_length, prediction_length, windows."""
    x = F.get(F.col(field), 0) if is_multivariate(df, field) else F.col(field)
    dims = F.max(F.size(field)) if is_multivariate(df, field) else F.lit(1)
    got = df.agg(F.count("*").alias("series"), dims.cast("int").alias("dims"), F.min(F.size(x)).alias("min_length"), F.sum(F.size(x)).alias("sum_length"))
    return got.withColumn("prediction_length", F.lit(prediction)).withColumn("windows", window_count(F.col("min_length"), prediction))


def calibration_windows(min_length: int, prediction: int, test_windows: int, requested: int, least: int = 10) -> int:
    """Calibration windows that fit before the test windows: all for -1, else up to those requested; under `least`
    none (0), so the task is left out."""
    fit = min_length // prediction - test_windows - 1
    got = fit if requested == -1 else min(fit, requested)
    return got if got >= least else 0


def splits(df: DataFrame, prediction: int, windows: int, field: str = "target", id_column: str = "item_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training, validation, test): series cut before the last windows + 1 and windows horizons; test has a row per
    window with its input and label."""
    n = F.size(field)
    cut = lambda k: F.slice(field, 1, F.greatest(n - prediction * k, F.lit(0)))
    at = n - prediction * (windows - F.col("w"))
    test = df.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(windows - 1)))).where(at > 0)
    test = test.select(id_column, "w", F.slice(field, 1, at).alias("input"), F.slice(field, at + 1, prediction).alias("label"))
    return df.withColumn(field, cut(windows + 1)), df.withColumn(field, cut(windows)), test


def truncate(x: Column, context: int) -> Column:
    """The last `context` entries."""
    return F.slice(x, F.greatest(F.size(x) - context + 1, F.lit(1)), context)


def filled(x: Column) -> Column:
    """Gaps carried forward, then backward; 0 if there is nothing at all."""
    none = F.struct(F.array().cast("array<double>").alias("out"), F.lit(None).cast("double").alias("last"))

    def carry(acc: Column, v: Column) -> Column:
        now = F.coalesce(F.nanvl(v, F.lit(None).cast("double")), acc["last"])
        return F.struct(F.concat(acc["out"], F.array(now)).alias("out"), now.alias("last"))

    ahead = F.aggregate(x, none, carry, lambda a: a["out"])
    first = F.get(F.filter(ahead, lambda v: v.isNotNull()), 0)
    return F.transform(ahead, lambda v: F.coalesce(v, first, F.lit(0.0)))


def with_meta(df: DataFrame, **meta) -> DataFrame:
    """Metadata (freq, variate_names, ..) kept as JSON on the first column."""
    c = df.columns[0]
    return df.withMetadata(c, {"calibrant": json.dumps(meta)})


def meta(df: DataFrame) -> dict:
    """What with_meta kept; {} where there is none or it can't be read."""
    try:
        return json.loads(df.schema[0].metadata.get("calibrant", "{}"))
    except ValueError:
        return {}


def left_padded(x: Column, n: int) -> Column:
    """The last n entries, with nulls before them where there are fewer."""
    tail = truncate(x, n)
    lack = F.greatest(F.lit(n) - F.size(x), F.lit(0))
    return F.concat(F.array_repeat(F.lit(None).cast("double"), lack), tail)


def extended(df: DataFrame, prediction: int, test_windows: int, requested: int, field: str = "target", id_column: str = "item_id", least: int = 10) -> DataFrame:
    """Test windows and the calibration windows that fit before them, as rows of (id, w, input, label, split): the cutoff
    of the first window moves back by a horizon for each. No rows where fewer than `least` fit, as the task is skipped; 0
    asked for are test windows alone."""
    shortest = df.agg(F.min(F.size(field))).first()[0] or 0
    n_cal = calibration_windows(shortest, prediction, test_windows, requested, least) if requested else 0
    if requested and not n_cal:
        return splits(df, prediction, test_windows, field, id_column)[2].withColumn("split", F.lit("test")).where("false")
    every = splits(df, prediction, test_windows + n_cal, field, id_column)[2]
    return every.withColumn("split", F.when(F.col("w") < n_cal, "cal").otherwise("test"))


def context_scan(df: DataFrame, prediction: int, windows: int, field: str = "target") -> DataFrame:
    """One row: num_series, max_context (the longest past before the first of the windows) and horizon."""
    return df.agg(F.count("*").alias("num_series"), (F.max(F.size(field)) - prediction * windows).alias("max_context"), F.lit(prediction).alias("horizon"))


def arrow_rows(spark: SparkSession, path: str, pattern: str = "*.arrow") -> DataFrame:
    """Rows of all Arrow files (IPC files or streams) under path, at any depth; each file is read by one task. The schema
    is the first file's."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)

    def tables(batches):
        for batch in batches:
            for content in batch.column("content"):
                source = pa.BufferReader(content.as_buffer())
                try:
                    yield pa.ipc.open_file(source).read_all()
                except pa.ArrowInvalid:
                    source.seek(0)
                    yield pa.ipc.open_stream(source).read_all()

    def schemas(batches):
        for t in tables(batches):
            yield pa.RecordBatch.from_pydict({"schema": [from_arrow_schema(t.schema).json()]})

    def rows(batches):
        for t in tables(batches):
            yield from t.cast(wanted).to_batches(max_chunksize=1_000)

    first = files.select("path", "content").orderBy("path").limit(1).mapInArrow(schemas, "schema string").first()
    if first is None:
        raise ValueError(f"no Arrow files under {path}")
    schema = T.StructType.fromJson(json.loads(first["schema"]))
    wanted = to_arrow_schema(schema)
    return files.select("content").mapInArrow(rows, schema)


def tasks(config: dict) -> list[dict]:
    """Task rows of a benchmark configuration: entries of "tasks" as they are, or "datasets" by their terms. Datasets
    are a list of {name, terms, ..}, or a map from name to {test_length, val_length, short: {prediction_length}, ..}, of
    which each term's windows cover the test length."""
    if "tasks" in config:
        return [dict(t) for t in config["tasks"]]
    if "datasets" not in config:
        raise ValueError("neither tasks nor datasets in the configuration")
    entries, out = config["datasets"], []
    if isinstance(entries, dict):
        for key, d in entries.items():
            name, _, freq = key.partition("/")
            freq = freq or "H"
            for term in TERMS:
                if term in d:
                    h = d[term]["prediction_length"]
                    test, val = d.get("test_length"), d.get("val_length")
                    windows = max(1, ceil(test / h)) if test else d.get("num_windows") or max(1, ceil(d.get("min_length", h * 10) * TEST_SHARE / h))
                    cal = config.get("cal_windows", 0)
                    cal = (ceil(val / h) if val else 0) if cal == "val_length" else int(cal or 0)
                    out.append({"dataset": key, "name": name, "freq": freq, "term": term, "horizon": h, "seasonality": seasonality(freq), "num_windows": windows, "cal_windows": cal, "task_name": f"{key}_{term}"})
        return out
    for d in entries:
        name, _, freq = d["name"].partition("/")
        freq = d.get("freq") or freq.split("/")[-1] or "D"
        for term in d.get("terms", ["short"]):
            if term not in TERMS:
                raise ValueError(f"unknown term: {term}")
            h = d.get("horizon") or horizon(freq, term)
            out.append({"dataset": d["name"], "name": name, "freq": freq, "term": term, "horizon": h, "seasonality": seasonality(freq), "num_windows": d.get("num_windows") or max(1, ceil(d.get("min_length", h * 10) * TEST_SHARE / h))})
    return out


def load_tasks(spark: SparkSession, *paths: str) -> list[dict]:
    """Tasks of several YAML or JSON files, one after the other; a file that can't be read is left out with a warning.
    Files are read by Spark, so they may lie in any store."""
    out = []
    for path in paths:
        try:
            text = spark.read.text(path, wholetext=True).first()[0]
            out += tasks(json.loads(text) if path.endswith(".json") else _yaml(text))
        except Exception as e:
            warnings.warn(f"{path}: {type(e).__name__}: {e}", stacklevel=2)
    return out


def _yaml(text: str) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise ValueError("YAML files need the yaml package; JSON ones don't") from e
    return yaml.safe_load(text)
