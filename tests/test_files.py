"""Arrow files and NumPy archives as data sources: partitions, pruned columns, filters, schemas that differ."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import datasource as ds

from calibrant.sources import files, store


def written(path, table, rows=None, stream=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    with pa.OSFile(str(path), "wb") as f, (pa.ipc.new_stream if stream else pa.ipc.new_file)(f, table.schema) as w:
        w.write_table(table, max_chunksize=rows)


@pytest.fixture
def arrow(tmp_path):
    one = pa.table({"item_id": [f"s{k}" for k in range(1000)], "n": pa.array(range(1000), pa.int32()), "target": [[float(k)] * 3 for k in range(1000)]})
    written(tmp_path / "a" / "one.arrow", one, 100)
    written(tmp_path / "b" / "two.arrow", pa.table({"item_id": ["t"], "n": pa.array([5_000_000_000], pa.int64()), "extra": ["x"]}))
    written(tmp_path / "c" / "three.arrow", pa.table({"item_id": ["u", None], "target": [[7.0], None]}), stream=True)
    return str(tmp_path)


def test_a_file_is_read_by_a_task_a_record_batch(spark, arrow):
    rows = files.read_arrow(spark, f"{arrow}/a/one.arrow")
    assert rows.rdd.getNumPartitions() == 10 and files.read_arrow(spark, f"{arrow}/a", run=4).rdd.getNumPartitions() == 3
    assert rows.count() == 1000 and sorted(r["n"] for r in rows.select("n").collect()) == [*range(1000)]


def test_schemas_of_files_are_united(spark, arrow):
    rows = files.read_arrow(spark, arrow)
    assert dict(rows.dtypes) == {"item_id": "string", "n": "bigint", "target": "array<double>", "extra": "string"}
    got = {r["item_id"]: r for r in rows.where("item_id IS NULL OR item_id NOT LIKE 's%'").collect()}
    assert got["t"]["n"] == 5_000_000_000 and got["t"]["target"] is None and got["u"]["target"] == [7.0] and got["u"]["n"] is None and got[None]["target"] is None
    assert rows.count() == 1003


def test_columns_that_are_not_asked_for_are_not_decoded(spark, arrow):
    rows = files.read_arrow(spark, arrow, columns=["n", "item_id"])
    assert rows.columns == ["n", "item_id"] and rows.where("n = 7").collect()[0]["item_id"] == "s7"
    reader = files.ArrowFiles({"path": f"{arrow}/a", "columns": "n"})
    made = reader.reader(reader.schema())
    batch = next(made._batches(made.partitions()[0]))
    assert batch.schema.names == ["n"] and batch.num_rows == 100


def test_filters_drop_rows_before_spark(spark, arrow):
    source = files.ArrowFiles({"path": arrow, "filters": "true"})
    reader = source.reader(source.schema())
    odd = ds.Not(ds.EqualTo(("n",), 3))
    assert [*reader.pushFilters([ds.GreaterThanOrEqual(("n",), 990), odd, ds.LessThan(("n",), 1000)])] == [odd]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 10
    kept = spark.conf.get(files.PUSHDOWN)
    spark.conf.set(files.PUSHDOWN, "true")
    try:
        assert files.read_arrow(spark, arrow).where("n >= 990 AND n < 1000 AND n <> 993").count() == 9
        assert files.read_arrow(spark, arrow).where("extra = 'x'").count() == 1
    finally:
        spark.conf.set(files.PUSHDOWN, kept)


def test_nothing_there(spark, arrow):
    with pytest.raises(Exception, match="no file"):
        files.read_arrow(spark, arrow, pattern="*.feather")


@pytest.fixture
def archives(tmp_path):
    rng = np.random.default_rng(0)
    point = rng.normal(size=(5, 3, 4))
    np.savez(tmp_path / "all.npz", predictions=point, q0_1=np.asfortranarray(point - 1))
    np.savez_compressed(tmp_path / "packed.npz", predictions=point.astype(np.float32))
    (tmp_path / "window_7").mkdir()
    np.savez(tmp_path / "window_7" / "p.npz", predictions=point[0])
    return str(tmp_path), point


def by_place(rows):
    return {(r["file"].rsplit("/", 1)[1], r["name"], r["w"], r["i"]): [round(x, 5) for x in r["values"]] for r in rows.collect()}


def test_archives_as_the_whole_reader_has_them(spark, archives, monkeypatch):
    path, point = archives
    assert by_place(files.read_npz(spark, path)) == by_place(store.npz_rows(spark, path))
    got = by_place(files.read_npz(spark, path))
    assert len(got) == 2 * 15 + 15 + 3 and got["p.npz", "predictions", 7, 2] == [round(x, 5) for x in point[0, 2]]
    source = files.NpzFiles({"path": path})
    monkeypatch.setattr(files, "NPZ_ROWS", 2)
    reader = source.reader(source.schema())
    assert len(reader.partitions()) == 5 * 3 + 1
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 48


def test_windows_that_are_not_asked_for_are_not_opened(archives, monkeypatch):
    monkeypatch.setattr(files, "NPZ_ROWS", 3)
    source = files.NpzFiles({"path": archives[0], "filters": "true"})
    reader = source.reader(source.schema())
    assert [*reader.pushFilters([ds.EqualTo(("name",), "predictions"), ds.LessThan(("w",), 2)])] == []
    parts = reader.partitions()
    assert len(parts) == 4 and {b.column(2)[0].as_py() for p in parts for b in reader.read(p)} == {0, 1}


def test_arrays_of_objects_are_refused(spark, tmp_path):
    np.savez(tmp_path / "x.npz", a=np.array([{"a": 1}], dtype=object))
    with pytest.raises(Exception, match="objects"):
        files.read_npz(spark, str(tmp_path)).collect()
