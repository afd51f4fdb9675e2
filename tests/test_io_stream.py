import os
import tempfile

from pyspark.sql import functions as F

from tabforge.sources import loader, sinks
from tabforge.streaming import stream as stm
from tabforge.sources.tables import fixture, table
from tabforge.queries import _cls_run

from conftest import SF_SMALL


def _write(text, suffix):
    d = tempfile.mkdtemp(prefix="tabforge-io-")
    p = os.path.join(d, "f" + suffix)
    with open(p, "w") as fh:
        fh.write(text)
    return p


def test_messy_csv(spark):
    p = _write(" id ; x ;name;Unnamed: 3\n1;2.5;a;\n\n2;3.5;b;\n", ".csv")
    assert loader.detect_delimiter(spark, p) == ";"
    df = loader.load_table(spark, p)
    assert df.columns == ["id", "x", "name"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 2.5, "a"), (2, 3.5, "b")]


def test_json_list_and_object(spark):
    lst = loader.load_table(spark, _write('[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]', ".json"))
    assert lst.count() == 2
    one = loader.load_table(spark, _write('{"a": 1, "b": "x"}', ".json"))
    assert one.count() == 1 and set(one.columns) == {"a", "b"}


def test_xml_missing_field(spark):
    p = _write("<rows><row><a>1</a><b>x</b></row><row><a>2</a></row></rows>", ".xml")
    df = loader.load_table(spark, p)
    got = sorted((r.a, r.b) for r in df.collect())
    assert got == [("1", "x"), ("2", None)]


def test_history_and_manifest(spark):
    d = tempfile.mkdtemp(prefix="tabforge-hist-")
    df = spark.createDataFrame([(i,) for i in range(15)], "x long")
    sinks.append_history(df, d + "/h")
    assert sinks.history_count(spark, d + "/h") == 15
    assert sinks.history_last(spark, d + "/h").count() == 10
    m = {r.artifact: r.exists for r in sinks.manifest(spark, {"h": d + "/h", "none": d + "/nope"}).collect()}
    assert m == {"h": True, "none": False}


def test_stream_equals_batch_profile(spark):
    ev = table(spark, SF_SMALL, "events")
    s = stm.read_stream(spark, f"{SF_SMALL}/events.parquet", ev.schema)
    streamed = stm.run_to_memory(stm.windowed_profile(s, "ts", "value", "1 day", "1 day", ["event_type"]))
    batch = stm.windowed_profile(ev, "ts", "value", "1 day", "1 day", ["event_type"])
    key = lambda r: (r.window_start, r.event_type)
    a = sorted((tuple(r) for r in streamed.collect()), key=str)
    b = sorted((tuple(r) for r in batch.collect()), key=str)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:5] == y[:5]


def test_stream_scoring_equals_batch(spark):
    from tabforge.operators.models import score
    r = _cls_run(spark, SF_SMALL, ["LogisticRegression"])
    model = r.result.models["LogisticRegression"]
    o = table(spark, SF_SMALL, "orders")
    batch = {x.o_orderkey: (x.prediction, x.confidence) for x in
             score(o, r.prep, model, keep=["o_orderkey"]).collect()}
    s = stm.read_stream(spark, f"{SF_SMALL}/orders.parquet", o.schema)
    streamed = stm.run_to_memory(stm.score_stream(s, r.prep, model, keep=["o_orderkey"]), mode="append")
    got = {x.o_orderkey: (x.prediction, x.confidence) for x in streamed.collect()}
    assert got == batch


def test_write_report_nulls_non_finite(spark):
    d = tempfile.mkdtemp(prefix="tabforge-report-")
    df = spark.createDataFrame([("a", float("nan")), ("b", float("inf")), ("c", 1.23456789)],
                               "column_name string, v double").repartition(3)
    sinks.write_report(df, d + "/r")
    got = {r.column_name: r.v for r in spark.read.json(d + "/r").collect()}
    assert got["a"] is None and got["b"] is None and abs(got["c"] - 1.23456789) < 1e-4
    assert len(got) == 3


def test_checkpoint_dir_needs_shared_folder_on_cluster():
    """No machine-local scratch folder on a cluster: an unset setting raises."""
    import pytest
    from types import SimpleNamespace
    from tabforge.session import checkpoint_dir
    sc = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: default, set=lambda k, v: None),
                           sparkContext=sc)
    with pytest.raises(RuntimeError):
        checkpoint_dir(fake)
    shared = SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: "hdfs:///ckpt", set=lambda k, v: None),
                             sparkContext=sc)
    assert checkpoint_dir(shared) == "hdfs:///ckpt"
