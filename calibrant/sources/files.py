"""Arrow IPC files and NumPy archives as Spark data sources.

A partition is a run of record batches of a file, or of windows of an archive's array, so that one large file is read by
many tasks and none holds a whole file. Columns that aren't asked for aren't decoded; filters of simple comparisons drop
partitions or rows before Spark sees them. File systems are pyarrow's, by the path's scheme: a local or mounted path, or
a store that pyarrow knows. Stores that only Spark reads go through datasets.arrow_rows and store.npz_rows.
"""

from __future__ import annotations

import operator
import re
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatch
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
MAGIC = b"ARROW1"
#: Rows of an archive's array that pass at once.
NPZ_ROWS = 10_000
NPZ = pa.schema([("file", pa.string()), ("name", pa.string()), ("w", pa.int32()), ("i", pa.int32()), ("values", pa.list_(pa.float64()))])
COMPARED = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le}
MASKS = {ds.EqualTo: pc.equal, ds.GreaterThan: pc.greater, ds.GreaterThanOrEqual: pc.greater_equal, ds.LessThan: pc.less, ds.LessThanOrEqual: pc.less_equal}


def found(path: str, pattern: str) -> list[str]:
    """Files under path (or path itself) that match, in order, as URIs' paths; none is an error."""
    system, base = fs.FileSystem.from_uri(path)
    info = system.get_file_info(base)
    infos = [info] if info.is_file else system.get_file_info(fs.FileSelector(base, recursive=True)) if info.type == fs.FileType.Directory else []
    got = sorted(i.path for i in infos if i.is_file and (i.path == base or fnmatch(i.base_name, pattern)))
    if not got:
        raise ValueError(f"no file {pattern} under {path}")
    return got


class Run(ds.InputPartition):
    """Entries first to last of a file: record batches (last None: a stream, which is read through), or windows of array
    `name`."""

    def __init__(self, file: str, first: int, last: int | None, name: str | None = None):
        self.file, self.first, self.last, self.name = file, first, last, name


class _Files(ds.DataSource):
    PATTERN = "*"

    def _list(self) -> tuple[fs.FileSystem, list[str]]:
        path = self.options["path"]
        return fs.FileSystem.from_uri(path)[0], found(path, self.options.get("pattern", self.PATTERN))


class ArrowFiles(_Files):
    """Rows of all IPC files and streams under `path`; options: pattern, columns (comma-joined; None: all of any file), and
    run, the number of record batches a partition (1). A column that a file lacks is null; types are widened."""

    PATTERN = "*.arrow"

    @classmethod
    def name(cls) -> str:
        return "calibrant_arrow"

    def schema(self) -> StructType:
        system, files = self._list()
        each = []
        for file in files:
            with system.open_input_file(file) as f:
                each.append((pa.ipc.open_file(f) if _is_file(f) else pa.ipc.open_stream(f)).schema.remove_metadata())
        whole = pa.unify_schemas(each, promote_options="permissive")
        if columns := self.options.get("columns"):
            whole = pa.schema([whole.field(c) for c in columns.split(",")])
        return from_arrow_schema(whole)

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        kind = FilteringArrowReader if self.options.get("filters") == "true" else ArrowReader
        return kind(*self._list(), schema, int(self.options.get("run", 1)))


def _is_file(f: pa.NativeFile) -> bool:
    """Whether it is an IPC file, not a stream; the file is at its start again."""
    head = f.read(len(MAGIC))
    f.seek(0)
    return head == MAGIC


class ArrowReader(ds.DataSourceReader):
    def __init__(self, system: fs.FileSystem, files: list[str], schema: StructType, run: int):
        self.system, self.files, self.wanted, self.run = system, files, to_arrow_schema(schema), run
        self.masks: list[tuple] = []

    def partitions(self) -> list[Run]:
        out = []
        for file in self.files:
            with self.system.open_input_file(file) as f:
                if not _is_file(f):
                    out.append(Run(file, 0, None))
                    continue
                n = pa.ipc.open_file(f).num_record_batches  # the footer alone
            out += [Run(file, k, min(k + self.run, n)) for k in range(0, n, self.run)]
        return out

    def _batches(self, part: Run) -> Iterator[pa.RecordBatch]:
        with self.system.open_input_file(part.file) as f:
            whole = part.last is not None
            names = (pa.ipc.open_file(f) if whole else pa.ipc.open_stream(f)).schema.names
            f.seek(0)
            wanted = {*self.wanted.names, *(c for c, _, _ in self.masks)}
            options = pa.ipc.IpcReadOptions(included_fields=[i for i, n in enumerate(names) if n in wanted])
            if whole:
                source = pa.ipc.open_file(f, options=options)
                for k in range(part.first, part.last):
                    yield source.get_batch(k)
            else:
                yield from pa.ipc.open_stream(f, options=options)

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        for batch in self._batches(partition):
            masks = [pc.fill_null(MASKS[kind](batch.column(c), value), False) for c, kind, value in self.masks if c in batch.schema.names]
            if len(masks) < len(self.masks):  # a column that isn't there is null, which no comparison takes
                continue
            if masks:
                batch = batch.filter(reduce(pc.and_, masks))
            if batch.num_rows:
                columns = [batch.column(f.name).cast(f.type) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in self.wanted]
                yield pa.RecordBatch.from_arrays(columns, schema=self.wanted)


class FilteringArrowReader(ArrowReader):
    """Where the session lets filters through to Python sources."""

    def pushFilters(self, filters: list) -> Iterator:
        """Comparisons of a column with a value are done on record batches, before they become rows."""
        for f in filters:
            if type(f) in MASKS and len(f.attribute) == 1 and f.value is not None:
                self.masks.append((f.attribute[0], type(f), f.value))
            else:
                yield f


class NpzFiles(_Files):
    """(file, name, w, i, values) of the arrays in NumPy archives under `path`: arrays of windows by items by steps, or of
    items by steps, whose window is the number in the file's folder (else 0). Arrays of objects are refused."""

    PATTERN = "*.npz"

    @classmethod
    def name(cls) -> str:
        return "calibrant_npz"

    def schema(self) -> StructType:
        return from_arrow_schema(NPZ)

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        kind = FilteringNpzReader if self.options.get("filters") == "true" else NpzReader
        return kind(*self._list(), schema)


class NpzReader(ds.DataSourceReader):
    def __init__(self, system: fs.FileSystem, files: list[str], schema: StructType):
        self.system, self.files, self.wanted = system, files, to_arrow_schema(schema)
        self.kept: list[tuple] = []

    def _takes(self, **values) -> bool:
        return all(test(values[c], value) for c, test, value in self.kept if c in values)

    def partitions(self) -> list[Run]:
        out = []
        for file in self.files:
            if not self._takes(file=file):
                continue
            with self.system.open_input_file(file) as f, zipfile.ZipFile(f) as z:
                for member in z.namelist():
                    name = member.removesuffix(".npy")
                    if self._takes(name=name):
                        shape = _head(z, member)[0]
                        n, at = (shape[0], None) if len(shape) == 3 and shape[0] > 1 else (1, _window(file))
                        step = max(1, NPZ_ROWS // max(1, shape[-2] if len(shape) > 1 else 1))
                        out += [Run(file, k, min(k + step, n), name) for k in range(0, n, step) if any(self._takes(w=w if at is None else at) for w in range(k, min(k + step, n)))]
        return out

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        with self.system.open_input_file(partition.file) as f, zipfile.ZipFile(f) as z:
            shape, fortran, kind, _ = _head(z, f"{partition.name}.npy")
            shape = (1,) * (3 - len(shape)) + shape
            of_folder = shape[0] == 1
            with z.open(f"{partition.name}.npy") as member:
                np.lib.format.read_magic(member)
                _read_header(member)
                if fortran:  # steps of all windows lie side by side, so the array is read whole
                    x = np.frombuffer(member.read(), dtype=kind).reshape(shape, order="F")[partition.first : partition.last]
                else:
                    slab = kind.itemsize * shape[1] * shape[2]
                    member.seek(partition.first * slab, 1)
                    x = np.frombuffer(member.read((partition.last - partition.first) * slab), dtype=kind).reshape(-1, *shape[1:])
            for k, block in enumerate(x, partition.first):
                w = _window(partition.file) if of_folder else k
                if self._takes(w=w):
                    for start in range(0, len(block), NPZ_ROWS):
                        rows = block[start : start + NPZ_ROWS].astype(float)
                        made = {"file": [partition.file] * len(rows), "name": [partition.name] * len(rows), "w": [w] * len(rows), "i": list(range(start, start + len(rows))), "values": list(rows)}
                        yield pa.RecordBatch.from_pydict(made, schema=NPZ).select(self.wanted.names)


class FilteringNpzReader(NpzReader):
    """Where the session lets filters through to Python sources."""

    def pushFilters(self, filters: list) -> Iterator:
        """Comparisons of file, name and w choose partitions; what they leave out is never opened."""
        for f in filters:
            if type(f) in COMPARED and len(f.attribute) == 1 and f.attribute[0] in ("file", "name", "w"):
                self.kept.append((f.attribute[0], COMPARED[type(f)], f.value))
            else:
                yield f


def _window(file: str) -> int:
    got = re.search(r"window_(\d+)", file)
    return int(got[1]) if got else 0


def _read_header(member) -> tuple:
    return np.lib.format.read_array_header_1_0(member)


def _head(z: zipfile.ZipFile, member: str) -> tuple[tuple, bool, np.dtype, None]:
    """(shape, Fortran order, type) of an array, from its header."""
    with z.open(member) as f:
        version = np.lib.format.read_magic(f)
        if version != (1, 0):
            raise ValueError(f"{member}: header version {version}")
        shape, fortran, kind = _read_header(f)
    if kind.hasobject:
        raise ValueError(f"{member}: an array of objects")
    return shape, fortran, kind, None


def _load(spark: SparkSession, source: type[_Files], path: str, options: dict) -> DataFrame:
    """A frame of the source. Filters reach it where the session lets them through to Python sources."""
    spark.dataSource.register(source)
    options = {**options, "filters": str(spark.conf.get(PUSHDOWN)).lower()}
    return spark.read.format(source.name()).options(**{k: v for k, v in options.items() if v is not None}).load(path)


def read_arrow(spark: SparkSession, path: str, columns: list[str] | None = None, pattern: str | None = None, run: int = 1) -> DataFrame:
    """Rows of all Arrow files under path, by many tasks a file; of `columns` alone if they are given."""
    return _load(spark, ArrowFiles, path, {"columns": ",".join(columns) if columns else None, "pattern": pattern, "run": run})


def read_npz(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """store.npz_rows by many tasks an archive."""
    return _load(spark, NpzFiles, path, {"pattern": pattern})


def write_arrow(rows: DataFrame, path: str) -> DataFrame:
    """(file, rows) of IPC files under path, one a partition, a record batch an Arrow batch of the session. A retried task
    writes its own file again. Lazy: files are there once the frame has been read."""
    schema, into = to_arrow_schema(rows.schema), path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(into)
        file = f"{base}/part-{TaskContext.get().partitionId():05d}.arrow"
        system.create_dir(base, recursive=True)
        n = 0
        with system.open_output_stream(file) as f, pa.ipc.new_file(f, schema) as w:
            for batch in batches:
                w.write_batch(batch.cast(schema))
                n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"file": [file], "rows": [n]})

    return rows.mapInArrow(run, "file string, rows bigint")
