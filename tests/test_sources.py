"""Files of other formats, task configurations and the command line."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from calibrant.__main__ import main
from calibrant.sources import datasets as dt
from calibrant.sources import store


def test_arrow_files_and_streams(spark, tmp_path):
    one = pa.table({"item_id": ["a", "b"], "target": [[1.0, 2.0], [3.0]]})
    two = pa.table({"item_id": ["c"], "target": [[4.0]]})
    (tmp_path / "deep").mkdir()
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as f, pa.ipc.new_file(f, one.schema) as w:
        w.write_table(one)
    with pa.OSFile(str(tmp_path / "deep" / "y.arrow"), "wb") as f, pa.ipc.new_stream(f, two.schema) as w:
        w.write_table(two)
    got = {r["item_id"]: list(r["target"]) for r in dt.arrow_rows(spark, str(tmp_path)).collect()}
    assert got == {"a": [1.0, 2.0], "b": [3.0], "c": [4.0]}
    with pytest.raises(ValueError, match="no Arrow files"):
        dt.arrow_rows(spark, str(tmp_path), "*.feather")


def test_npz_windows(spark, tmp_path):
    """Windows by series by steps in one archive, or an archive for each window."""
    rng = np.random.default_rng(0)
    point, low, truth = rng.normal(size=(3, 2, 4)), rng.normal(size=(3, 2, 4)), rng.normal(size=(3, 2, 4))
    (tmp_path / "one").mkdir()
    np.savez(tmp_path / "one" / "predictions.npz", predictions=point, q0_1=low, **{"quantile_0.9": low + 1})
    np.savez(tmp_path / "one" / "ground_truth.npz", target=truth)
    for w in (0, 10):
        (tmp_path / "many" / f"window_{w}").mkdir(parents=True)
        np.savez(tmp_path / "many" / f"window_{w}" / "predictions.npz", predictions=point[0] + w)
    rows = store.npz_rows(spark, str(tmp_path / "one"))
    pred = store.npz_windows(rows.where("file LIKE '%predictions%'"))
    true = store.npz_windows(rows.where("file LIKE '%truth%'"), "none")
    panel = store.import_windows(pred, true, "t", "m", 1).collect()
    assert len(panel) == 24 and {r["split"] for r in panel if r["w"] == 0} == {"cal"}
    for r in panel:
        at = r["w"], int(r["series"][-1]), r["h"]
        assert (r["y"], r["yhat"]) == (truth[at], point[at]) and r["q"]["q90"] == low[at] + 1
    many = store.npz_windows(store.npz_rows(spark, str(tmp_path / "many"))).collect()
    assert {(r["w"], r["item_id"]): r["predictions"][0] for r in many} == {(w, f"series_{i}"): point[0, i, 0] + w for w in (0, 10) for i in (0, 1)}


def test_configurations(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("cal_windows: val_length\ndatasets:\n  Water/15T:\n    test_length: 1440\n    val_length: 100\n    short: {prediction_length: 16}\n    long: {prediction_length: 288}\n")
    (tmp_path / "b.json").write_text(json.dumps({"tasks": [{"dataset_path": "x", "horizon": 3}]}))
    (tmp_path / "c.yaml").write_text("nothing: 1\n")
    with pytest.warns(UserWarning, match="neither tasks nor datasets"):
        got = dt.load_tasks(spark, *(str(tmp_path / f) for f in ("a.yaml", "c.yaml", "b.json")))
    assert [(t.get("term"), t["horizon"], t.get("num_windows"), t.get("cal_windows")) for t in got] == [("short", 16, 90, 7), ("long", 288, 5, 1), (None, 3, None, None)]
    assert got[0]["seasonality"] == 96 and got[0]["freq"] == "15T"


def test_extension_skips_short_series(spark):
    df = spark.createDataFrame([("a", [float(i) for i in range(60)]), ("b", [float(i) for i in range(50)])], "item_id string, target array<double>")
    assert dt.extended(df, 2, 3, 12).groupBy("split").count().orderBy("split").collect() == [("cal", 24), ("test", 6)]
    assert dt.extended(df, 5, 2, 12).count() == 0 and dt.extended(df, 5, 2, 0).where("split = 'test'").count() == 4
    first = dt.extended(df, 2, 3, -1).where("item_id = 'b'").orderBy("w").first()
    assert first["split"] == "cal" and len(first["label"]) == 2 and first["label"][0] == float(len(first["input"]))


def test_caches_are_kept_by_parameters(spark, tmp_path):
    made = []

    def build(n):
        made.append(n)
        return spark.range(n)

    root = str(tmp_path)
    assert store.cached(spark, root, lambda: build(3), n=3).count() == 3
    assert store.cached(spark, root, lambda: build(3), n=3).count() == 3 and made == [3]
    assert store.cached(spark, root, lambda: build(4), n=4).count() == 4 and store.cached(spark, root, lambda: build(5), force=True, n=3).count() == 5
    assert made == [3, 4, 5]


def test_html_holds_the_document(spark):
    doc = spark.createDataFrame([('{"a": "</script>"}',)], "document string")
    assert store.html(doc).count("</script>") == 1 and "<title>Results</title>" in store.html(doc)


def test_command_line(spark, tmp_path):
    rows = [(f"s{i}", [float((j * (i + 2)) % 7 + j % 24) for j in range(120)]) for i in range(6)]
    spark.createDataFrame(rows, "item_id string, target array<double>").write.parquet(str(tmp_path / "series"))
    common = ["--predictions", str(tmp_path / "panel")]
    assert main(["forecast", "--series", str(tmp_path / "series"), *common, "--horizon", "3", "--windows", "4", "--cal-windows", "12", "--forecaster", "last", "--context", "48"]) == 0
    panel = store.read_panel(spark, str(tmp_path / "panel"))
    assert panel.groupBy("split").count().orderBy("split").collect() == [("cal", 6 * 12 * 3), ("test", 6 * 4 * 3)]
    assert main(["cp_eval", *common, "--results", str(tmp_path / "out"), "--methods", "SplitCP", "JointCFRNN", "--alpha", "0.2", "0.4", "--cal-windows", "10"]) == 0
    got = store.read_results(spark, str(tmp_path / "out"), "task string, model string, method string, coverage double")
    assert got.groupBy("alpha", "method").count().where("count = 1").count() == 6
    assert main(["cp_eval", *common, "--results", str(tmp_path / "cv"), "--methods", "SplitCP", "--cross-sectional-cv", "3"]) == 0
    assert main(["cp_eval", *common, "--results", str(tmp_path / "one"), "--methods", "TrailingWindow", "--single-step", "--online", "--window", "10"]) == 0
    assert store.read_results(spark, str(tmp_path / "cv"), "method string, coverage double").where(F.col("method") == "SplitCP").count() == 1


def test_exports():
    import calibrant

    assert all(callable(getattr(calibrant, n)) or n == "SCORES" for n in calibrant.__all__)
    with pytest.raises(AttributeError):
        calibrant.nothing


def test_results_of_many_splits_and_of_none(spark, tmp_path):
    """A file's header is its first line, however many tasks read it."""
    (tmp_path / "r").mkdir()
    rows = "".join(f"m{k},{k / 1000}\n" for k in range(500))
    (tmp_path / "r" / "x_alpha0.2_abs_all_marginal.csv").write_text("method,coverage\n" + rows)
    (tmp_path / "r" / "y_alpha0.1_cqr_all_marginal.csv").write_text("coverage_mean,method\n0.5,other\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        got = store.read_results(spark, str(tmp_path / "r"), "method string, coverage double").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert len(got) == 501 and {r["method"]: r["coverage"] for r in got}["other"] == 0.5
    assert all(r["coverage"] == int(r["method"][1:]) / 1000 for r in got if r["method"] != "other")
    (tmp_path / "none").mkdir()
    assert store.read_results(spark, str(tmp_path / "none"), "method string, coverage double").count() == 0


def test_documents_of_differing_shapes(spark, tmp_path):
    texts = ['{"name": "a", "n": 4, "at": {"alpha": 0.1}}', '{"name": 7, "n": "5", "alpha": "0.2"}', '{"n": {"x": 1}, "at": [1]}', "not json", "[1, 2]"]
    for i, t in enumerate(texts):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "m.json").write_text(t + "\n")
    fields = {"name": (("$.name",), "string"), "n": (("$.n",), "int"), "alpha": (("$.at.alpha", "$.alpha"), "double")}
    got = store.read_documents(spark, str(tmp_path), fields).orderBy("file").drop("file").collect()
    assert [tuple(r) for r in got] == [("a", 4, 0.1), ("7", 5, 0.2), (None, None, None), (None, None, None), (None, None, None)]
    assert store.read_documents(spark, str(tmp_path), fields, "*.none").count() == 0
