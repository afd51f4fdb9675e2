"""R22 on streams, and the idempotent log."""

import shutil

import pytest
from pyspark.sql import functions as F

from tabforge.streaming import stream as stm


def source(spark, tmp_path, rows):
    src = f"{tmp_path}/src"
    for r in rows:
        spark.createDataFrame(r, "id long, x double").coalesce(1).write.mode("append").parquet(src)
    return stm.read_stream(spark, src, spark.read.parquet(src).schema, max_files_per_trigger=1)


def start(tmp_path):
    return lambda out: (out.writeStream.format("parquet").option("path", f"{tmp_path}/out")
                        .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start())


def test_contract_kept(spark, tmp_path):
    s = source(spark, tmp_path, [[(1, 1.0), (2, None)], [(3, 3.0)]])
    q = stm.checked_stream(s, lambda d: d.fillna(0.0), ["x"], start(tmp_path))
    assert q.exception() is None and spark.read.parquet(f"{tmp_path}/out").count() == 3


@pytest.mark.parametrize("broken,says", [(lambda d: d, "nulls"), (lambda d: d.where("id <> 3").fillna(0.0), "became")])
def test_contract_broken_stops_the_query(spark, tmp_path, broken, says):
    s = source(spark, tmp_path, [[(1, 1.0)], [(3, None), (4, 1.0)], [(5, 1.0)]])
    with pytest.raises(stm.ContractBroken, match=says):
        stm.checked_stream(s, broken, ["x"], start(tmp_path))


def test_replayed_batch_is_logged_once(spark, tmp_path):
    log, ck = f"{tmp_path}/log", f"{tmp_path}/ck"
    s = source(spark, tmp_path, [[(1, 1.0)], [(2, 2.0)]])
    stm.append_once(s, log, "a", ck).awaitTermination()
    first = sorted((r["id"], r["run"], r["batch"]) for r in stm.logged_once(spark, log).collect())
    assert [r[0] for r in first] == [1, 2] and len({r[2] for r in first}) == 2
    # the commit of the last batch is lost: it is replayed, and replaces itself
    last = max(r[2] for r in first)
    for f in (f"{ck}/commits/{last}", f"{ck}/commits/.{last}.crc"):
        shutil.move(f, f"{tmp_path}/{f.rsplit('/', 1)[1]}")
    s = stm.read_stream(spark, f"{tmp_path}/src", spark.read.parquet(f"{tmp_path}/src").schema, max_files_per_trigger=1)
    stm.append_once(s, log, "a", ck).awaitTermination()
    assert sorted((r["id"], r["run"], r["batch"]) for r in stm.logged_once(spark, log).collect()) == first
    # another run has records of its own
    stm.append_once(s, log, "b", f"{tmp_path}/ck2").awaitTermination()
    assert stm.logged_once(spark, log).groupBy("run").count().orderBy("run").collect() == [("a", 2), ("b", 2)]
